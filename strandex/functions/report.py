"""Numbers as the command line shows them."""

from __future__ import annotations

from collections.abc import Iterable


def human(n: float) -> str:
    """Bytes in binary units, one decimal from KiB on."""
    power = min(4, max(0, (int(n).bit_length() - 1) // 10))
    return f"{n / 1024**power:.{1 if power else 0}f} {('B', 'KiB', 'MiB', 'GiB', 'TiB')[power]}"


def duration(seconds: float) -> str:
    """Hours, minutes and seconds, from the first that isn't 0 on."""
    minutes, s = divmod(int(seconds), 60)
    h, m = divmod(minutes, 60)
    return " ".join([*([f"{h}h"] if h else []), *([f"{m}m"] if minutes else []), f"{s}s"])


def share(part: float, whole: float) -> float:
    """Per cent; all of nothing is 100."""
    return 100.0 * part / whole if whole else 100.0


def rate(n: float, seconds: float, unit: str) -> str:
    """n a second: bytes by their units, other things counted."""
    each = n / max(seconds, 1e-9)
    return f"{human(each)}/s" if unit == "bytes" else f"{round(each):,} {unit}/s"


def smoothed(rates: Iterable[float], fresh: float = 0.3) -> float:
    """The rate that an estimate of the time left goes by: each new one counts `fresh`, what came before the rest."""
    kept = None
    for x in rates:
        kept = x if kept is None else (1 - fresh) * kept + fresh * x
    return kept or 0.0
