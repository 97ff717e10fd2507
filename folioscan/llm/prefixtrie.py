"""A prefix trie of conversations, built as a z-fast trie by joins.

A conversation is the sequence of its turns' digests (role and text, SHA-256, 128 bits), and each prefix has a name, a chain
of such hashes. Only these and word counts travel, never texts. Equal sequences are one string, so copies are counted once.

The trie is compacted: its nodes are the prefixes at which strings branch or end. A node is hashed at its handle: of the
depths after its parent's and up to its own, the one that the highest power of two divides. `locate` finds the deepest node
that a string passes by a fat binary search: each step asks for one handle, that of the fattest depth of what is left of the
interval, and at most as many steps as the string's length has bits are needed, as that power falls with each; a hit counts
if the node's own name is the string's too. The node below, told by the name one turn further, is the exit node, and the
string leaves the trie on its edge at their longest common prefix.

Strings are inserted in batches. All of a batch are located by the same joins; edges get a node wherever one of them leaves
or ends, and of those that leave at one place by one turn, a pioneer, drawn by hash, is hung in; the others wait for the
next batch, in which they leave deeper. So a batch takes all of a trie's branches on, a common first turn or a group of
copies holds up none, and the number of batches grows as the logarithm of the number of strings.

What holds for whole subtrees is summed by pointer jumping over the compacted nodes, in as many rounds as the deepest
path's number of nodes has bits; sums are combined before each shuffle. At last `expand` turns each edge into the nodes of
its depths, which share its members.

Defined cases: turns without conv_id belong to no conversation; a null role or text is empty; a null turn comes first, and
turns of one number go by their digests, so the order never depends on how rows come; rows that repeat are turns that
repeat; an empty table has no nodes, not even a root; other columns are not read. A conversation's digests, 24 bytes a turn,
are held by one task, as a document's text is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscan.llm.quality import words_of
from folioscan.session import discard, materialize, table

ROOT = bytes(16)
#: Strings of fewer turns are searched by themselves, so that they don't take part in longer strings' further steps.
SHORT = 16
#: Ids that are put together in a row before they are hashed.
IDS = 4096


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and `own`, its turns (digest, words) in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("set"), "turn", digest.alias("sym"), F.size(words_of(text)).cast("long").alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct("set", "turn", "sym", "words")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: F.struct(x["sym"].alias("sym"), x["words"].alias("words"))).alias("own"))


def rebuilt(conversations: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """conv_id and `turns`: the first h turns of the first conversation of its block, h from the id's checksum below `heads`, then its own after its first h."""
    own = materialize(turns(conversations), "turns")
    first = own.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("first"), F.slice("own", 1, max(heads - 1, 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    placed = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("first")).join(first, "first", "left")
    head = F.when(F.col("head").isNotNull() & (F.col("h") > 0), F.slice("head", 1, F.col("h")))
    none = F.slice("own", 1, 0)
    return placed.select("conv_id", F.concat(F.coalesce(head, none), F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, n, the names of all prefixes from the empty one on, and the words up to each."""
    for batch in batches:
        names, words, at, n = [], [], [0], []
        for syms, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            name, total = ROOT, 0
            names.append(name)
            words.append(total)
            for sym, count in zip(syms, counts, strict=True):
                name, total = hashlib.sha256(name + sym).digest()[:16], total + count
                names.append(name)
                words.append(total)
            at.append(len(names))
            n.append(len(syms))
        offsets = pa.array(at, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(names, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(words, pa.int64()))]
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int32()), *lists], names=["conv_id", "n", "p", "c"])


def named(sequences: DataFrame) -> DataFrame:
    """conv_id, n, p (names of its prefixes, by depth) and c (words up to each) of sequences (conv_id, turns)."""
    return sequences.select("conv_id", "turns.sym", "turns.words").mapInArrow(_named, "conv_id long, n int, p array<binary>, c array<bigint>")


def strings_of(convs: DataFrame) -> DataFrame:
    """The distinct sequences: sid (the whole's name), rep (the smallest conv_id), count, n, p and c."""
    same = convs.groupBy(F.get("p", F.col("n")).alias("sid")).agg(F.min("conv_id").alias("rep"), F.count("*").alias("count"))
    return convs.withColumnRenamed("conv_id", "rep").join(same, "rep")


def fattest(low: str, high: str) -> str:
    """Of the numbers above low and up to high, the one that the highest power of two divides."""
    return f"({high} & shiftleft(-1, length(bin({low} ^ {high})) - 1))"


def locate(strings: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """strings (rep, n, p, l) with l raised to the depth of the deepest node on the string's path, by fat binary search."""
    handles = nodes.where("depth > 0").select(F.col("handle").alias("key"), F.col("depth").alias("_depth"), F.col("id").alias("_id"))
    rows = strings.withColumn("r", F.col("n"))
    for _ in range(longest.bit_length()):
        asked = rows.withColumn("f", F.expr(f"CASE WHEN l < r THEN {fattest('l', 'r')} ELSE n END"))
        found = asked.withColumn("key", F.get("p", F.col("f"))).join(handles, "key", "left")
        open_, hit = F.col("l") < F.col("r"), F.coalesce(F.get("p", F.col("_depth")) == F.col("_id"), F.lit(False))
        rows = found.select("rep", "n", "p", F.when(open_ & hit, F.col("_depth")).otherwise(F.col("l")).alias("l"), F.when(open_ & ~hit, F.col("f") - 1).otherwise(F.col("r")).alias("r"))
    return rows.drop("r")


def _leaving(located: DataFrame, nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """Where each located string leaves the trie: at depth `at` by the name there, on the edge to node `exit` or, if that is null, at a node."""
    edges = nodes.where("depth > 0").select(F.col("name").alias("key"), F.col("id").alias("exit"), F.col("depth").alias("_depth"), F.col("rep").alias("_rep"))
    # a string that has come to its end asks for its last turn, and takes no notice of the answer
    asked = located.withColumn("key", F.get("p", F.least(F.col("l") + 1, F.col("n")))).join(edges, "key", "left")
    on = F.col("exit").isNotNull() & (F.col("l") < F.col("n"))
    # without an edge it meets itself, so that no key is common to all of these
    other = strings.select(F.col("rep").alias("_rep"), F.col("p").alias("_p"))
    met = asked.withColumns({"on": on, "_rep": F.when(on, F.col("_rep")).otherwise(F.col("rep"))}).join(other, "_rep")
    common = F.size(F.filter(F.sequence(F.col("l") + 1, F.least("n", "_depth")), lambda d: F.get("p", d) == F.get("_p", d)))
    left = met.withColumn("at", F.col("l") + F.when(F.col("on"), common).otherwise(0))
    return left.select(
        "rep", "n", "l", "at", F.get("p", F.col("n")).alias("sid"), F.get("p", F.col("at")).alias("place"), F.get("p", F.col("at") + 1).alias("name"), F.when(F.col("on"), F.col("exit")).alias("exit"),
        F.expr(f"CASE WHEN at < n THEN get(p, {fattest('at', 'n')}) END").alias("handle"),
    )


def _inserted(left: DataFrame, pioneers: DataFrame, nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """nodes with the strings of a batch that end within the trie, and the pioneers."""
    hung = left.join(pioneers, "rep", "left_semi")
    new = hung.select(F.col("sid").alias("id"), F.col("n").alias("depth"), F.col("place").alias("parent"), F.col("at").alias("above"), "name", "handle", "rep")
    cut = left.where("at = n").unionByName(hung).where("exit IS NOT NULL").select("exit", F.col("place").alias("id"), F.col("at").alias("depth")).distinct()
    whole = nodes.join(cut.select(F.col("exit").alias("id")).distinct(), "id", "left_semi")
    points = cut.unionByName(whole.select(F.col("id").alias("exit"), "id", "depth"))
    along = Window.partitionBy("exit").orderBy("depth")
    edges = whole.select(F.col("id").alias("exit"), "parent", "above", "rep")
    pieces = points.withColumns({"_id": F.lag("id").over(along), "_depth": F.lag("depth").over(along)}).join(edges, "exit")
    pieces = pieces.select("id", "depth", F.coalesce("_id", "parent").alias("parent"), F.coalesce("_depth", "above").alias("above"), "rep").join(strings.select("rep", "p"), "rep")
    split = pieces.select("id", "depth", "parent", "above", F.get("p", F.col("above") + 1).alias("name"), F.expr(f"get(p, {fattest('above', 'depth')})").alias("handle"), "rep")
    return nodes.join(cut.select(F.col("exit").alias("id")).distinct(), "id", "left_anti").unionByName(split).unionByName(new)


def build(strings: DataFrame) -> DataFrame:
    """The compacted nodes of strings (rep, n, p): id (its name), depth, parent, above (the parent's depth), name (of the prefix one turn below the parent), handle, rep (a string on its path)."""
    spark = strings.sparkSession
    root = spark.range(1).select(F.lit(ROOT).alias("id"), F.lit(0).alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(None).cast("int").alias("above"), F.lit(None).cast("binary").alias("name"), F.lit(None).cast("binary").alias("handle"))
    first = strings.agg(F.max("n").alias("n"), F.min("rep").alias("rep")).first()
    nodes = materialize(root.withColumn("rep", F.lit(first["rep"]).cast("long")), "nodes")
    longest, waiting, empty = first["n"] or 0, None, True
    while True:
        batch = strings.select("rep", "n", "p", F.lit(0).alias("l")) if waiting is None else strings.select("rep", "n", "p").join(waiting, "rep")
        if empty:
            located = batch
        elif longest < SHORT:
            located = locate(batch, nodes, longest)
        else:
            located = locate(batch.where(F.col("n") < SHORT), nodes, SHORT - 1).unionByName(locate(batch.where(F.col("n") >= SHORT), nodes, longest))
        left = materialize(_leaving(located, nodes, strings), "leaving")
        pioneers = left.where("at < n").groupBy("name").agg(F.min_by("rep", F.xxhash64("rep")).alias("rep")).select("rep")
        before, nodes = nodes, materialize(_inserted(left, pioneers, nodes, strings), "nodes")
        later = materialize(left.where("at < n").join(pioneers, "rep", "left_anti").select("rep", "l"), "waiting")
        for old in (before, left, *([waiting] if waiting is not None else [])):
            discard(old)
        if later.isEmpty():
            discard(later)
            return nodes
        waiting, empty = later, False


def subtrees(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """nodes with n_convs, least (the smallest conv_id), n_leaves, children, passed and own: over all strings that end in a node's subtree the sum of their words, and over the subtree's edges, its own included, of theirs."""
    ends = strings.select(F.col("sid").alias("id"), F.col("rep").alias("least"), F.col("count").alias("n_convs"), (F.col("count") * F.get("c", F.col("n"))).alias("passed"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("children")).withColumnRenamed("parent", "id")
    words = strings.select("rep", "c")
    edge = F.get("c", F.col("depth")) - F.get("c", F.coalesce("above", F.lit(0)))
    whole = nodes.join(words, "rep").select("id", "depth", "parent", "above", "rep", edge.alias("own")).join(ends, "id", "left").join(children, "id", "left")
    zero = F.lit(0).cast("long")
    fixed = whole.select(
        "id", "depth", "parent", "above", "rep", F.coalesce("children", zero).alias("children"), "own", "least", F.coalesce("n_convs", zero).alias("n_convs"), F.coalesce("passed", zero).alias("passed"),
        F.when(F.col("children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), F.col("parent").alias("jump"),
    )
    now = materialize(fixed, "subtrees")
    sums, least = ("own", "n_convs", "passed", "n_leaves"), "least"
    while not now.where("jump IS NOT NULL").isEmpty():
        below = now.where("jump IS NOT NULL").groupBy("jump").agg(*[F.sum(s).alias(f"_{s}") for s in sums], F.min(least).alias("_least")).withColumnRenamed("jump", "id")
        further = now.select(F.col("id").alias("_to"), F.col("jump").alias("_jump"))
        # a node whose jump is past the root asks itself, whose jump is past it too
        joined = now.withColumn("_to", F.coalesce("jump", "id")).join(below, "id", "left").join(further, "_to")
        kept = [c for c in now.columns if c not in (*sums, least, "jump")]
        more = [(F.col(s) + F.coalesce(f"_{s}", zero)).alias(s) for s in sums]
        before, now = now, materialize(joined.select(*kept, *more, F.least("least", "_least").alias("least"), F.col("_jump").alias("jump")), "subtrees")
        discard(before)
    return now.drop("jump")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of sid and conv_id: the ids of a sid, comma-joined, in rows of IDS at most."""
    own, ids = None, []
    for batch in batches:
        out: list[tuple] = []
        for sid, conv in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            if ids and (sid != own or len(ids) == IDS):
                out.append((own, ids[0], ",".join(map(str, ids))))
                ids = []
            own = sid
            ids.append(conv)
        yield _rows(out)
    if ids:
        yield _rows([(own, ids[0], ",".join(map(str, ids)))])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 3
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["sid", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of such rows in the order of sid and first: the digest of all ids of a sid; of a sid nothing is held but the digest's state."""
    own, state = None, None
    rows = lambda done: pa.record_batch([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], names=["sid", "ends"])
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for sid, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if sid != own:
                if state is not None:
                    done.append((own, state.hexdigest()))
                own, state = sid, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(done)
    if state is not None:
        yield rows([(own, state.hexdigest())])


def end_digests(convs: DataFrame) -> DataFrame:
    """sid and ends: the SHA-256 of the conv_ids of each whole sequence. Ids are dealt out by range and put together, so that a sequence of many conversations is a few rows where it is hashed."""
    dealt = convs.select(F.get("p", F.col("n")).alias("sid"), "conv_id").repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id")
    gathered = dealt.mapInArrow(_gathered, "sid binary, first long, ids string").repartition("sid").sortWithinPartitions("sid", "first")
    return gathered.select("sid", "ids").mapInArrow(_hashed, "sid binary, ends string")


def expand(nodes: DataFrame, strings: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes of all depths of compacted nodes with their subtrees' sums."""
    above = nodes.select(F.col("id").alias("parent"), F.col("least").alias("_least"))
    whole = nodes.withColumn("parent", F.coalesce("parent", "id")).join(above, "parent").join(strings.select("rep", "c"), "rep").join(ends.withColumnRenamed("sid", "id"), "id", "left")
    # the words before a depth, for each depth of the edge
    depths = F.when(F.col("depth") == 0, F.array(F.struct(F.lit(0).alias("d"), F.lit(0).cast("long").alias("before")))).otherwise(
        F.arrays_zip(F.sequence(F.col("above") + 1, F.col("depth")).alias("d"), F.slice("c", F.col("above") + 1, F.col("depth") - F.col("above")).alias("before"))
    )
    start = F.get("c", F.coalesce("above", F.lit(0)))
    keep = ["depth", "above", "least", "_least", "n_convs", "children", "n_leaves", "passed", "own", "ends"]
    rows = whole.withColumn("start", start).select(*keep, "start", F.explode(depths).alias("e")).select(*keep, "start", "e.d", "e.before")
    bottom = F.col("d") == F.col("depth")
    saved = F.col("passed") - F.col("n_convs") * F.col("before") - F.col("own") + F.col("before") - F.col("start")
    return rows.select(
        F.col("least").alias("conv_id"),
        F.col("d").cast("long").alias("depth"),
        F.when(F.col("d") > F.col("above") + 1, F.col("least")).when(F.col("d") > 0, F.col("_least")).alias("parent_conv_id"),
        "n_convs",
        F.when(bottom, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        saved.alias("saved_tokens"),
        F.coalesce(F.when(bottom, F.col("ends")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns)."""
    convs = materialize(named(sequences), "conversations")
    strings = materialize(strings_of(convs), "strings")
    if strings.isEmpty():
        return convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    compact = build(strings)
    summed = subtrees(compact, strings)
    discard(compact)
    return expand(summed, strings, end_digests(convs))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS sym, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS w FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sym, w) AS k FROM s),
i AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS head FROM s),
c AS (SELECT conv_id, head, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
  lambda a, b: list_reduce([xor(a, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END))), 4294967295::BIGINT) % 4 AS h FROM i),
r AS (SELECT c.conv_id, 0 AS part, k, sym, w FROM c JOIN o ON o.conv_id = head AND k <= h UNION ALL SELECT c.conv_id, 1, k, sym, w FROM c JOIN o ON o.conv_id = c.conv_id AND k > h),
e AS (SELECT conv_id, sym, w, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS d FROM r),
p AS MATERIALIZED (SELECT conv_id, d, w, string_agg(sym, '') OVER (PARTITION BY conv_id ORDER BY d) AS key FROM e UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS MATERIALIZED (SELECT d, key, substr(key, 1, 32 * greatest(d - 1, 0)) AS up, count(*) AS n_convs, min(conv_id) AS conv_id, any_value(w) AS w FROM p GROUP BY d, key),
l AS (SELECT conv_id, max(d) AS d FROM p GROUP BY conv_id),
f AS (SELECT d, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM p JOIN l USING (conv_id, d) GROUP BY d, key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT p.d, p.key, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((n_convs - 1) * n.w) AS saved FROM n LEFT JOIN k USING (d, key) JOIN p ON p.conv_id = n.conv_id AND p.d <= n.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM n LEFT JOIN n u ON n.d > 0 AND u.d = n.d - 1 AND u.key = n.up LEFT JOIN k ON k.d = n.d AND k.key = n.key LEFT JOIN f ON f.d = n.d AND f.key = n.key JOIN a ON a.d = n.d AND a.key = n.key
"""
