"""Document fingerprints from spot signatures. DataFrame operations only.

A signature is a common word (the anchor) and the chain of the next CHAIN content words behind it, common words
skipped; chains look at most AHEAD anchors on, and are shorter where less text follows. Texts are lower-cased words of
letters and digits, so marks, layout and boilerplate without anchors don't count. A fingerprint is the set of a text's
signatures as ascending 32-bit hashes in hexadecimal, eight digits each. A text without an anchor has its words as
signatures; one without words, but not empty, its whole text; an empty or null text has the empty fingerprint.

Likeness is the Jaccard similarity of two fingerprints' sets, 1 for two empty ones. Likeness of t or more needs
lengths within a factor 1 / t, so that sets are partitioned by length and compared with their own and the next
partition alone, there only where they share one of their rarest signatures, and Jaccard is computed only if the
lengths still allow it (near_groups).

Null texts are empty; ids may be null or repeated (rows of one id follow each other in the order of a hash of the
text); an empty table gives no rows; columns other than id and text are not read, whatever their names; very long texts
are read whole.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dropped, table, written
from .components import components
from .sharding import bucket as _bucket
from .sharding import sampled_splitters

CHAIN, AHEAD = 2, 3
#: Bytes of documents that stand next to each other in one partition of the window, about; partitions at most.
NEIGHBOURS, BUCKETS = 8 << 20, 1 << 18
#: Bits by which signatures are counted for their order.
FREQUENCY_BITS = 18
#: Rounds of stars at most, before what is left is compared pair by pair; nodes of a chunk of a list then, about.
STARS, CHUNK = 5, 1000
#: Pairs whose nodes are broadcast, and groups that are, at most; above, joins are shuffled ones.
BROADCAST_PAIRS = BROADCAST_GROUPS = 1_000_000
#: Common words of English, German, French and Spanish.
ANCHORS = """
a about after all also an and any are as at be because been but by can could do for from had has have he her his how
i if in into is it its more most my no not of on one only or other our out she so some such than that the their them
then there these they this to up was we were what when which who will with would you your
aber als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich
ihr im ist kann mit nach nicht noch nur oder sein sich sie sind über um und uns von vor wenn werden wie wir zu zum zur
au aux avec ce cette dans de du elle en est et il ils je la le les leur lui mais même ne nous ou où par pas plus pour
que qui sa se ses son sur un une vous y
al como con cuando del desde donde el ella ellos entre era esta este ha hay las lo los muy o para pero por porque quien
ser si sin sobre son su sus también tiene una ya
""".split()


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the column `out`: the ascending, different signatures of `text` as longs below 2 to the 32."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    t = f"_{out}_"
    df = df.withColumn(t + "w", F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    marked = F.transform(t + "w", lambda w: F.when(w.isin(ANCHORS), F.concat(F.lit("\n"), w, F.lit("\t"))).otherwise(F.concat(w, F.lit(" "))))
    df = df.withColumn(t + "s", F.split(F.array_join(marked, ""), "\n"))
    df = df.withColumn(t + "c", F.transform(t + "s", lambda s: F.substring_index(s, "\t", -1)))
    content = t + "c"

    def signature(s: Column, k: Column) -> Column:
        following = F.concat_ws("", *(F.get(F.col(content), k + i) for i in range(AHEAD + 1)))
        return F.xxhash64(F.substring_index(s, "\t", 1), F.substring_index(following, " ", CHAIN)).bitwiseAND(0xFFFFFFFF)

    spots = F.filter(F.transform(t + "s", lambda s, k: F.when(k > 0, signature(s, k))), lambda x: x.isNotNull())
    df = df.withColumn(t + "x", spots)
    words = F.transform(t + "w", lambda w: F.xxhash64(w).bitwiseAND(0xFFFFFFFF))
    whole = F.when(low == "", F.array().cast("array<long>")).otherwise(F.array(F.xxhash64(low).bitwiseAND(0xFFFFFFFF)))
    found = F.when(F.size(t + "x") > 0, F.col(t + "x")).when(F.size(t + "w") > 0, words).otherwise(whole)
    return df.withColumn(out, F.sort_array(F.array_distinct(found))).drop(t + "w", t + "s", t + "c", t + "x")


def as_text(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two signature columns; 0 without a comparison where lengths keep it below at_least."""
    shared = F.size(F.array_intersect(F.col(a), F.col(b)))
    short, long_ = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(long_ == 0, 1.0).when((short == 0) | (short < at_least * long_), 0.0).otherwise(shared / (short + long_ - shared))


def _prefix_lists(nodes: DataFrame, at_least: float) -> DataFrame:
    """key, class, node, n, pos (of the key in the node's order): the lists of more than one node on which near ones meet.

    Signatures are ordered by how often the 2^FREQUENCY_BITS classes of their low bits occur, rarest first, then by
    value: one order for all, told by a constant of a byte for each class. A node is on the lists of its first
    n - ceil(at_least n) + 1 signatures, in its own class of lengths and as a guest in the next."""
    classes = 1 << FREQUENCY_BITS
    low = F.col("sig").bitwiseAND(classes - 1)
    often = bytearray(classes)
    for row in nodes.select(F.explode("sigs").alias("sig")).groupBy(low.alias("at")).agg(F.count("*").alias("n")).toLocalIterator():
        often[row.at] = min(255, int(4 * log2(1 + row.n)))
    table_ = F.lit(bytes(often))
    ranked = F.sort_array(F.transform("sigs", lambda x: F.struct(F.substring(table_, x.bitwiseAND(classes - 1) + 1, F.lit(1)).alias("often"), x.alias("sig"))))
    first = F.slice(ranked, F.lit(1), n_prefix("n", at_least).cast("int"))
    # a window, as a count joined with its own rows is two shuffles: the count's has fewer columns
    listed = nodes.select("node", "n", F.posexplode(first).alias("pos", "at")).select("node", "n", "pos", F.col("at.sig").alias("key"))
    one_list = Window.partitionBy("key")
    shared = listed.withColumn("low", F.min("node").over(one_list)).withColumn("high", F.max("node").over(one_list)).where("low <> high")
    # classes of lengths: [1/t^k, 1/t^(k+1)); a set meets those of its own class and of the next
    of = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / at_least)) + 1e-9).cast("int")
    return shared.select("key", F.explode(F.array(of, of + 1)).alias("class"), "node", "n", "pos")


def _linked(pairs: DataFrame, nodes: DataFrame, at_least: float) -> DataFrame:
    """The pairs (a, b) of likeness at_least or more."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    some = nodes.select("node", "sigs").join(F.broadcast(wanted) if pairs.count() <= BROADCAST_PAIRS else wanted, "node")
    both = pairs
    for c in "ab":
        both = both.join(some.select(F.col("node").alias(c), F.col("sigs").alias(f"sigs_{c}")), c)
    return both.where(likeness("sigs_a", "sigs_b", at_least) >= at_least - 1e-12).select("a", "b")


def near_groups(docs: DataFrame, at_least: float = 0.8, id: str = "doc_id", text: str = "text") -> DataFrame:
    """node, group: for each fingerprint (node: its hash) that has several rows or a near one, the smallest id of all
    rows that links of likeness at_least or more connect with it. All other rows are groups of their own.

    Links are found on the lists of each partition of lengths, of rarest signatures first, by pruned Jaccard; a pair is
    compared only where its lengths, and what stands behind its places on the list, allow a link. On each
    list one node is the centre that others are compared with; links make components, and from round to round only
    nodes of different components are compared, so that a large group costs no more than its rows. Pairs of different
    components that are left at last are all compared, long lists in pairs of chunks that spread over tasks.

    Ids may be null or repeated; the smallest id is of those that aren't null. Empty fingerprints have no links and no
    group; an empty table gives no rows; other columns are not read. Nodes are 64-bit hashes of fingerprints."""
    own = with_signatures(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), "text", "sigs")
    own = own.select("id", node_of("sigs").alias("node"), F.transform("sigs", lambda x: (x - (1 << 31)).cast("int")).alias("sigs"))
    nodes = own.groupBy("node").agg(F.first("sigs").alias("sigs"), F.min("id").alias("low"), F.count("*").alias("times")).where(F.size("sigs") > 0)
    nodes = written(nodes.withColumn("n", F.size("sigs")), "nodes")
    lists = written(_prefix_lists(nodes, at_least), "lists")
    labels, links, done = None, None, None
    turn = 0
    while not lists.isEmpty():
        named = lists.withColumn("label", F.col("node"))
        if labels is not None:
            named = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        named = written(named, "named")
        centre = F.min(F.struct(F.xxhash64(F.lit(turn), "node").alias("rank"), F.col("node"), F.col("n"), F.col("pos"), F.col("label"))).alias("c")
        each = named.groupBy("key", "class", "label").agg(F.count("*").alias("m"), centre)
        each = each.groupBy("key", "class").agg(F.sum("m").alias("nodes"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count("*").alias("labels"), F.min("c").alias("c"))
        open_ = written(each.where("labels > 1"), "open")
        dropped(lists)
        lists = written(named.join(open_.select("key", "class", "nodes", "c"), ["key", "class"]), "lists")
        dropped(named)
        if lists.isEmpty():
            break
        left, few = open_.agg(F.sum((F.col("nodes") * F.col("nodes") - F.col("same")) / 2), F.sum(4 * F.col("nodes"))).first()
        last = left <= few or turn == STARS
        if last:
            parts = F.ceil(F.col("nodes") / CHUNK).cast("int")
            spread = lists.withColumn("chunk", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            spread = spread.withColumn("low", F.least("chunk", "other")).withColumn("high", F.greatest("chunk", "other"))
            one, two = (spread.select("key", "class", "low", "high", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "pos", "label"))) for c in "ab")
            pairs = one.join(two, ["key", "class", "low", "high"]).where("node_a < node_b and label_a <> label_b")
        else:
            pairs = lists.where("label <> c.label").select(F.col("node").alias("node_a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("c.node").alias("node_b"), F.col("c.n").alias("n_b"), F.col("c.pos").alias("pos_b"))
        fits = F.least("n_a", "n_b") >= at_least * F.greatest("n_a", "n_b") - 1e-9
        # on the first list that two share, all that they share stands from their places in it on
        fits &= F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b")) >= at_least / (1 + at_least) * (F.col("n_a") + F.col("n_b")) - 1e-9
        pairs = pairs.where(fits).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        found = written(_linked(pairs, nodes, at_least), "links")
        done = pairs if done is None else done.union(pairs)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links)
        if last:
            break
        lists = lists.drop("label", "nodes", "c")
        # where a round finds nothing, the next one compares what is left
        turn = STARS if found.isEmpty() else turn + 1
    nodes = nodes.select("node", "low", "times")
    if labels is None:
        return nodes.where("times > 1").select("node", F.col("low").alias("group"))
    nodes = nodes.join(labels, "node", "left").where("times > 1 or label is not null").withColumn("label", F.coalesce("label", "node"))
    named = written(nodes.select("node", "label", "low"), "grouped")
    return named.select("node", "label").join(named.groupBy("label").agg(F.min("low").alias("group")), "label").select("node", "group")


def node_of(signatures: str) -> Column:
    return F.xxhash64(F.array_join(signatures, " "))


def n_prefix(n: str, at_least: float) -> Column:
    return F.col(n) - F.ceil(at_least * F.col(n) - 1e-9) + 1


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", at_least: float = 0.8) -> DataFrame:
    """doc_id, n_chars, fingerprint of each row, and of its text edited: the last quarter of its code points replaced
    by the first as many of the next row's (by id, then text; null ids first; the first row after the last), with the
    likeness of both to the row's own. Repeated rows follow each other. An empty table gives no rows.

    group_id is the smallest id of all rows that links of at_least (default 0.8) or more connect with the row, its own
    if there are none or its fingerprint is empty."""
    groups = written(near_groups(docs, at_least, id, text), "groups")
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text") + 64
    total, nulls, low = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.count_if(F.col("doc_id").isNull()), F.min("doc_id")).first()
    buckets = max(1, min(BUCKETS, total // NEIGHBOURS))
    splitters: list[int] = []
    if buckets > 1:
        sized = rows.withColumn("size", size)
        splitters = [x for x in sampled_splitters(sized, "doc_id", "size", total, buckets, F.lit(5), "doc_id", "size") if x != low]
    # every splitter is an id: the first of its bucket, which the bucket before needs as the next of its last row
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(_bucket("doc_id", splitters))
    leads = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(low)
    opens = (_bucket("doc_id", splitters) > 0) & (_bucket("doc_id", splitters) > _bucket_below("doc_id", splitters)) if splitters else F.lit(False)
    rows = rows.withColumn("bucket", bucket.cast("int"))
    places = F.concat(
        F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guest"))),
        F.when(F.coalesce(opens, F.lit(False)), F.array(F.struct((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array()),
        F.when(F.coalesce(leads, F.lit(False)), F.array(F.struct(F.lit(len(splitters)).alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array()),
    )
    rows = rows.select("doc_id", "text", F.explode(places).alias("place")).select("doc_id", "text", "place.*")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = with_signatures(rows.withColumn("next_text", F.lead("text").over(order)), "text", "sigs")
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(order)).where("not guest")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.expr("left(text, n_chars - cast(floor(n_chars / 4) as int))"), F.left(F.col("next_text"), quarter)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    rows = rows.withColumn("node", node_of("sigs"))
    rows = rows.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "node", "left")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sigs").alias("fingerprint"), as_text("edited_sigs").alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").alias("near_edited"), likeness("sigs", "next_sigs").alias("near_next"), F.size("sigs").alias("n_signatures"),
        F.coalesce("group", "doc_id").alias("group_id"),
    )


def _bucket_below(key: str, splitters: list[int]) -> Column:
    """_bucket of key - 1: differs from that of key if key is a splitter."""
    return _bucket(key, [s + 1 for s in splitters])


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
