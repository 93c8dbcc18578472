"""Table shapes. Lengths and offsets are bytes; nothing is null except a sequence that wasn't asked for."""

RECORDS = "source_file string, file_format string, input_ordinal long, full_id string, header string, virtual_offset long, sequence_length long, line_bases long, line_width long"
RECORDS_WITH_SEQUENCE = RECORDS + ", sequence binary"
FAI = "input_ordinal long, full_id string, sequence_length long, raw_offset long, line_bases long, line_width long"
GZI = "compressed long, uncompressed long"
INDEX_COLUMNS = ["record_id", *(c.split()[0] for c in RECORDS.split(", "))]
