"""Operator 9: near-duplicate documents by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitegauge.llm.common import append_columns, scratch, sorted_groups, write_out
from sitegauge.llm.components import connected_components, forest
from sitegauge.sources.tables import read_table

SHINGLE_WORDS, THRESHOLD = 5, 80  # words, per cent of the union
#: Minwise values of a sketch, independent trees, and values that a root branches on.
VALUES, TREES, CHILDREN = 128, 6, 2
#: Share of the later nodes that branch on two values, the others on one: 1.4 on average, above the 1 / 0.8 that keeps
#: the paths which a pair shares from dying out.
SECOND = 0.4
#: Nodes of at most so many sets are compared exhaustively; larger ones branch again, up to so many levels.
NODE, LEVELS = 128, 5
#: A large node that keeps this share of its parent's sets is dense: they agree on most values.
DENSE = 0.8
#: Values of the longer sketches by which the sets of large bundles are told apart once more.
REFINED = 1024
#: Sets are held for candidates from so many standard deviations below the share of equal values of a true link.
DEVIATIONS = 5
#: Bytes of the sets of a bundle that one task compares; of the pivots of a round and of a block in larger bundles.
BUNDLE_BYTES, PIVOT_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20, 2 << 20
#: Bytes of document ids that may be broadcast to fetch the texts of candidates; beyond, the join is shuffled.
BROADCAST_BYTES = 64 << 20

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PRIME, MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SHIFTS = np.uint64(30), np.uint64(27), np.uint64(31)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> SHIFTS[0])) * MIX_A
    h = (h ^ (h >> SHIFTS[1])) * MIX_B
    return h ^ (h >> SHIFTS[2])


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of ``words`` words; of all words if there are fewer."""
    tokens = text.encode().translate(LOWER).split()  # at bytes 20 and 09-0D
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=n)
    size = min(words, n)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = out * PRIME + mixed(hashed[i : n - size + 1 + i])
        return np.unique(mixed(out))


class Sketcher:
    """The least of ``values`` hashes over a set: equal in two sets with the probability of their similarity."""

    def __init__(self, values: int = VALUES):
        rng = np.random.default_rng(20_099 + values)
        self.values = values
        self.flip = rng.integers(0, 2**32, values, dtype=np.uint32)
        self.scale = rng.integers(0, 2**31, values, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        short = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.values, 2**32 - 1, dtype=np.uint32)
        step = 2048 * VALUES // self.values
        for a in range(0, len(short), step):
            low = np.minimum(low, ((short[a : a + step, None] ^ self.flip) * self.scale).min(axis=0))
        return low


def least_equal(values: int, threshold: int) -> int:
    """Equal values from which two sketches are candidates; a link has fewer with a chance of about 3e-7."""
    t = threshold / 100
    return int(values * (t - DEVIATIONS * (t * (1 - t) / values) ** 0.5))


def signature(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def start_features(words: int):
    sketch = Sketcher()

    def work(column):
        sizes, signs, sketches = [], [], []
        for t in column.to_pylist():
            found = shingle_set(t or "", words)
            sizes.append(len(found))
            signs.append(signature(found) if len(found) else None)
            sketches.append(sketch(found).tobytes() if len(found) else None)
        return [sizes, signs, sketches]

    return work


def branch(batches, roots: bool, values: int = VALUES):
    """Children of each row's path: the path grows by one of the set's minwise values, or by CHILDREN of them.

    How many and which values a node branches on follows from the path alone, so that all sets of a node agree on it.
    A child keeps its parent's number of sets (of a root's: 0).
    """
    for batch in batches:
        sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, values)
        ids = batch.column("class").to_numpy()
        if roots:
            paths = mixed(np.arange(1, TREES + 1, dtype=np.uint64))
            at, path = np.repeat(np.arange(len(ids)), TREES), np.tile(paths, len(ids))
            parents = np.zeros(len(at), dtype=np.int64)
        else:
            at, path, parents = np.arange(len(ids)), batch.column("path").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        made = []
        with np.errstate(over="ignore"):
            twice = np.ones(len(at), dtype=bool) if roots else mixed(path + PRIME) < np.uint64(int(SECOND * 2**64))
            for c in range(CHILDREN):
                here = slice(None) if c == 0 else twice
                own = path[here]
                drawn = mixed(own + np.uint64(c + 1) * PRIME)
                which = (drawn % np.uint64(values // CHILDREN)).astype(np.int64) * CHILDREN + c  # distinct among children
                token = sketches[at[here], which].astype(np.uint64) + (which.astype(np.uint64) << np.uint64(33))
                made.append((mixed(own * PRIME + mixed(token)), ids[at[here]], parents[here]))
        paths, classes, sizes = (np.concatenate(x) for x in zip(*made))
        columns = [pa.array(paths.view(np.int64)), pa.array(classes), pa.array(sizes)]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "class", "parent"])


def node_candidates(batches, values: int, threshold: int):
    """(class, root) of the sets of each small node that are candidates for one another, compared exhaustively.

    Sets whose sizes alone rule the similarity out are no candidates.
    """

    def convert(table):
        short = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint32).reshape(-1, values)
        return table.column("class").to_numpy(), (short & np.uint32(255)).astype(np.uint8), table.column("size").to_numpy()

    least = least_equal(values, threshold)
    ids, roots = [], []
    for classes, sketches, size in sorted_groups(batches, "path", convert):
        near = np.triu(100 * np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size), 1)
        a, b = np.nonzero(near)
        equal = [(sketches[a[i : i + 4096]] == sketches[b[i : i + 4096]]).sum(axis=1) >= least for i in range(0, len(a), 4096)]
        hit = np.concatenate([*equal, np.zeros(0, dtype=bool)])
        if hit.any():
            root = classes[forest(len(classes), a[hit], b[hit])]
            apart = classes != root
            ids.append(classes[apart])
            roots.append(root[apart])
        if len(ids) > 10_000:
            yield two_columns(ids, roots)
            ids, roots = [], []
    yield two_columns(ids, roots)


def two_columns(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    arrays = [pa.array(np.concatenate([*x, np.zeros(0, dtype=np.int64)]).astype(np.int64)) for x in (a, b)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b"])


def chosen_paths(classes: DataFrame, threshold: int, values: int = VALUES) -> DataFrame:
    """Links (a, b) that join all sets (class, size, sketch) whose sketches are candidates for one another.

    In each of TREES independent trees a set is branched by minwise values; a node is what shares a path.
    Nodes of one set end. Small nodes are compared; nodes of the same sets are compared once. Larger nodes
    branch again, unless they are dense. Dense nodes, and what is still large after LEVELS levels, are
    linked with the node's first set, unseen: the check of full sets decides.
    """
    kind = "path long, class long, parent long"
    rows = write_out(classes.select("class", "sketch").mapInArrow(partial(branch, roots=True, values=values), kind))
    links: list[DataFrame] = []
    for level in range(1, LEVELS + 1):
        sizes = rows.groupBy("path").agg(
            F.count("*").alias("n"), F.max("parent").alias("parent"), F.min("class").alias("least"),
            F.bit_xor(F.xxhash64("class")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("y"),
        )
        sizes = write_out(sizes.where("n > 1"))
        small = sizes.where(F.col("n") <= NODE).groupBy("n", "x", "y").agg(F.min("path").alias("path")).select("path")
        leaves = rows.join(small, "path").join(classes.select("class", "size", "sketch"), "class").select("path", "class", "size", "sketch")
        compare = partial(node_candidates, values=values, threshold=threshold)
        compared = leaves.repartition("path").sortWithinPartitions("path").mapInArrow(compare, "a long, b long")
        links.append(write_out(compared.distinct()))
        large = sizes.where(F.col("n") > NODE).select("path", "n", "least", ((F.col("n") >= DENSE * F.col("parent")) & (F.col("parent") > 0)).alias("dense"))
        if large.isEmpty():
            break
        ends = F.lit(True) if level == LEVELS else F.col("dense")
        links.append(rows.join(large.where(ends), "path").select(F.col("class").alias("a"), F.col("least").alias("b")).where("a <> b"))
        if level == LEVELS:
            break
        grown = rows.join(large.where(~F.col("dense")), "path").select("path", "class", "n").join(classes.select("class", "sketch"), "class")
        rows = write_out(grown.mapInArrow(partial(branch, roots=False, values=values), kind))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


class SetTable:
    """Sets of one task over the elements that occur in them, for intersections with one set at a time."""

    def __init__(self, sets: list[np.ndarray], threshold: int):
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.flat, self.mark, self.threshold = flat, np.zeros(len(universe), dtype=np.uint8), threshold

    def linked(self, one: int) -> np.ndarray:
        """Which sets have a similarity with set ``one`` of ``threshold`` per cent or more."""
        own = self.flat[self.starts[one] : self.starts[one] + self.sizes[one]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.flat], self.starts, dtype=np.int64)
        self.mark[own] = 0
        return 100 * both >= self.threshold * (self.sizes + self.sizes[one] - both)


def set_columns(table: pa.Table) -> tuple:
    return table.column("class").to_numpy(), [np.frombuffer(x, dtype=np.uint64) for x in table.column("shingles").to_pylist()]


def bundle_links(batches, threshold: int):
    """(class, root) of small bundles: from the smallest class, every set reached is compared with all that are not."""
    a, b = [], []
    for classes, sets in sorted_groups(batches, "bundle", set_columns):
        table, order = SetTable(sets, threshold), np.argsort(classes)
        new = np.ones(len(classes), dtype=bool)
        for root in order.tolist():
            if not new[root]:
                continue
            new[root] = False
            frontier = [root]
            while frontier and new.any():
                near = np.flatnonzero(table.linked(frontier.pop()) & new)
                new[near] = False
                frontier += near.tolist()
                a.append(classes[near])
                b.append(np.full(len(near), classes[root]))
        if len(a) > 10_000:
            yield two_columns(a, b)
            a, b = [], []
    yield two_columns(a, b)


def pivot_links(batches, threshold: int):
    """Links of a block of a large bundle with the round's pivots."""

    def convert(table):
        return *set_columns(table), table.column("pivot").to_numpy(zero_copy_only=False)

    a, b = [], []
    for classes, sets, pivot in sorted_groups(batches, "key", convert):
        table, label = SetTable(sets, threshold), np.arange(len(sets))
        for p in np.flatnonzero(pivot).tolist():
            near = np.flatnonzero(table.linked(p) & (label != label[p]))
            if len(near):
                merged = np.isin(label, label[near])
                label[merged] = label[p]
        root = classes[label]
        apart = classes != root
        a.append(classes[apart])
        b.append(root[apart])
    yield two_columns(a, b)


def large_bundle_links(members: DataFrame, threshold: int, turns: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links that connect the true components of bundles too large for a task, and the bundles still open after ``turns``.

    In rounds, pivots of about PIVOT_BYTES of each bundle are compared with all sets of the bundle, which lie
    in blocks of about BLOCK_BYTES. Sets that are linked get one label. A pair with unequal labels has a
    member outside the bundle's largest label, so once all of these have been pivots no link is missing.
    A dense bundle is done after a few rounds, as nearly all its sets then have one label.
    """
    links = members.sparkSession.createDataFrame([], "a long, b long")
    size = F.octet_length("shingles")
    state = write_out(members.select("class", "bundle", size.alias("bytes"), F.col("class").alias("label"), F.lit(False).alias("done")))
    blocks = state.groupBy("bundle").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("blocks"))
    turn = 0
    while True:
        counts = state.groupBy("bundle", "label").agg(F.count("*").alias("n"))
        largest = counts.groupBy("bundle").agg(F.max(F.struct("n", F.col("label").alias("main")))["main"].alias("main"))
        open_ = write_out(state.join(largest, "bundle").where((F.col("label") != F.col("main")) & ~F.col("done")).select("class", "bundle", "bytes"))
        if open_.isEmpty():
            return links, None
        if turn == turns:
            return links, open_.select("bundle").distinct()
        pending = open_.groupBy("bundle").agg(F.sum("bytes").alias("pending"))
        drawn = F.pmod(F.xxhash64(F.lit(turn), "class"), F.ceil(F.col("pending") / PIVOT_BYTES)) == 0
        pivots = write_out(open_.join(pending, "bundle").where(drawn).select("class", "bundle"))
        turn += 1
        if pivots.isEmpty():
            continue
        spread = members.join(pivots.select("class"), "class").join(blocks, "bundle")
        places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
        copies = spread.select("bundle", "class", "shingles", places, F.lit(True).alias("pivot"))
        own = members.join(pivots.select("bundle").distinct(), "bundle", "left_semi").join(blocks, "bundle")
        own = own.select("bundle", "class", "shingles", F.pmod(F.xxhash64("class"), F.col("blocks")).alias("block"), F.lit(False).alias("pivot"))
        keyed = own.unionByName(copies).select(F.xxhash64("bundle", "block").alias("key"), "class", "shingles", "pivot")
        found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(pivot_links, threshold=threshold), "a long, b long")
        links = write_out(links.unionByName(found).distinct())
        labels = connected_components(links).withColumnRenamed("node", "class")
        done = pivots.select("class", F.lit(True).alias("now"))
        state = state.drop("label").join(labels, "class", "left").join(done, "class", "left")
        state = write_out(
            state.select(
                "class", "bundle", "bytes", F.coalesce("root", "class").alias("label"), (F.col("done") | F.coalesce("now", F.lit(False))).alias("done")
            )
        )


def refined(members: DataFrame, threshold: int) -> DataFrame:
    """``members`` of large bundles in the smaller bundles that longer sketches leave.

    What chained sets together without being a link, as a passage that many texts share, has fewer equal
    values than a link by a margin that narrows with the sketch. Sets left alone have no link.
    """

    def sketches():
        sketch = Sketcher(REFINED)
        return lambda column: [[sketch(np.frombuffer(x, dtype=np.uint64)).tobytes() for x in column.to_pylist()]]

    classes = write_out(append_columns(members, ["shingles"], "sketch binary", sketches, ["class", "size"]))
    again = connected_components(chosen_paths(classes, threshold, REFINED))
    bundles = again.select(F.col("node").alias("class"), F.col("root").alias("bundle")).join(classes.select("class", "size"), "class")
    return members.select("class", "shingles").join(with_bytes(bundles), "class")


def with_bytes(bundles: DataFrame) -> DataFrame:
    """``bundles`` (class, bundle, size) with the bytes of the sets of each bundle."""
    return bundles.join(bundles.groupBy("bundle").agg((8 * F.sum("size")).alias("bytes")), "bundle")


def true_links(members: DataFrame, threshold: int) -> DataFrame:
    """Links that connect the true components of bundles: (bundle, bytes, class, size, shingles).

    Bundles that one task can hold are compared there. Larger ones take two rounds of pivots, which settle dense ones; those
    still open are told apart by longer sketches, and what is large even then is settled by pivots.
    """

    def compared(own: DataFrame) -> DataFrame:
        small = own.where(F.col("bytes") <= BUNDLE_BYTES).select("bundle", "class", "shingles")
        return small.repartition("bundle").sortWithinPartitions("bundle").mapInArrow(partial(bundle_links, threshold=threshold), "a long, b long")

    links, large = compared(members), members.where(F.col("bytes") > BUNDLE_BYTES)
    if large.isEmpty():
        return links
    found, still = large_bundle_links(large, threshold, turns=2)
    links = links.unionByName(found)
    if still is None:
        return links
    fewer = write_out(refined(large.join(still, "bundle", "left_semi"), threshold))
    rest, _ = large_bundle_links(fewer.where(F.col("bytes") > BUNDLE_BYTES), threshold)
    return links.unionByName(compared(fewer)).unionByName(rest)


def near_groups(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_shingles, component_id, group) and the columns of ``keep``, one row for each row of ``df``.

    Rows of one component have one ``group``, null for those that can't link; see ``near_duplicates``.
    """
    with scratch(df.sparkSession):
        return write_out(grouped(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *keep), words, threshold, keep), outlive=True)


def grouped(own: DataFrame, words: int, threshold: int, keep: tuple[str, ...]) -> DataFrame:
    features = write_out(append_columns(own, ["text"], "n_shingles long, sign binary, sketch binary", partial(start_features, words), ["doc_id", *keep]))
    by_sign = features.where("sign is not null and doc_id is not null").groupBy("sign")
    distinct = by_sign.agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("size"), F.max("sketch").alias("sketch"))
    classes = write_out(distinct.withColumn("class", F.monotonically_increasing_id()))
    bundles = connected_components(chosen_paths(classes, threshold)).withColumnRenamed("node", "class").withColumnRenamed("root", "bundle")
    wanted = write_out(with_bytes(bundles.join(classes.select("class", "sign", "first", "size"), "class")))
    ids = wanted.select(F.col("first").alias("doc_id")).distinct()
    # Their bytes: 8 for a number, else what the longest id takes in all.
    bytes_ = wanted.agg(F.count("*") * F.max(F.octet_length(F.col("first").cast("string")) + 8)).first()[0] or 0
    some = own.join(F.broadcast(ids) if bytes_ <= BROADCAST_BYTES else ids, "doc_id", "left_semi")

    def shingles():
        def work(column):
            found = [shingle_set(t or "", words) for t in column.to_pylist()]
            return [[signature(s) for s in found], [s.tobytes() for s in found]]

        return work

    sets = append_columns(some, ["text"], "sign binary, shingles binary", shingles, []).dropDuplicates(["sign"])
    members = write_out(wanted.join(sets, "sign").select("class", "bundle", "bytes", "size", "shingles"))
    roots = connected_components(true_links(members, threshold)).withColumnRenamed("node", "class")
    labelled = write_out(classes.select("class", "sign", "first").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    known = labelled.join(smallest, "root").select("sign", "component_id", F.col("root").alias("group"))
    found = features.select("doc_id", *keep, "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("sign")).alias("sign")).join(known, "sign", "left")
    return found.select("doc_id", *keep, "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "group")


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, threshold: int = THRESHOLD
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``df``.

    A text's set holds its distinct runs of ``words`` words (A-Z lower-cased, cut at ASCII white space); a
    shorter text's words are one run. Documents link if their sets share ``threshold`` per cent of their union; the
    trees' recall is stated for 80 or more. Equal sets are one class. Candidates are found by ``chosen_paths``, and bundles of candidates are
    decided on full sets. component_id is the smallest id reachable. Null, empty and blank texts and rows
    without an id link with nothing and are their own component. Repeated rows are copies like others.
    """
    own = F.col("doc_id") == F.col("component_id")
    return near_groups(df, doc_id, text, words, threshold).select("doc_id", "n_shingles", "component_id", F.coalesce(own, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct([array_to_string(w[i : i + least(4, len(w)) - 1], ' ') for i in range(1, len(w) - least(4, len(w)) + 2)]) AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS c, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s)),
elements AS (SELECT c, n, hash(e) AS e FROM (SELECT c, n, unnest(s) AS e FROM classes)),
links AS (SELECT a.c AS a, b.c AS b FROM elements a JOIN elements b ON a.e = b.e AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
twoway AS (FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT x.c, y.b FROM reach x JOIN twoway y ON y.a = x.r),
roots AS (SELECT c, min(r) AS r FROM reach GROUP BY c)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r, d.doc_id) AS component_id, d.doc_id = coalesce(r, d.doc_id) AS kept
FROM sets d LEFT JOIN classes k ON len(d.s) > 0 AND list_sort(d.s) = k.s LEFT JOIN roots ON roots.c = k.c"""


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, on runs of four words."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), words=4)
