"""Near-duplicate detection by min-max hashing.

A text's set is its distinct word shingles. Each of ``perms`` hash functions is
evaluated once a shingle and gives two signature values, the smallest and the
largest, so ``2 * perms`` values cost ``perms`` evaluations. Bands of ``r``
values propose links; the full shingle sets confirm them.

How the work is bounded:

* texts with equal sets form a class; only one member of a class is compared;
* in a band's bucket each member is compared with the bucket's smallest member
  (links in number of members, not pairs). The hub's set goes once to each
  block of ``BLOCK`` members;
* members of one bucket that remain in different components after that are
  compared block by block within a group, whole sets against whole sets; two
  blocks of one component need no comparison. No pairs are emitted: a task
  returns a spanning forest of the links it confirmed;
* such a group is a cluster of colliding buckets while all but its largest
  component have at most ``NARROW`` members; a wider one gives way to its
  buckets, each set of members once; a wider bucket to the members that share
  one of their rarest shingles in it (``_by_rare_shingles``), which two sets of
  the threshold always do. So a text is sent to a bounded number of blocks,
  except where thousands of different texts share a band and rare shingles;
* tables of hot keys (hubs, groups) have at most a row for ``BLOCK`` rows and
  are broadcast after a count; beyond that both sides are salted (``_put``);
* components are contracted in the cluster (``components``).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm.common import ASCII_LOWER, WordHashes, grams, mix, slices
from quarryline.llm.components import components
from quarryline.llm.native import quoted
from quarryline.session import materialize, release, scratch_scope

BLOCK = 128
#: Members besides the largest component that a group may have and still be compared as one.
NARROW = 1024
SALTS = 16
NO_OWNER = -(2**63)
#: A table of at most so many (id, id) rows may be broadcast: 16 bytes a row.
BROADCAST_ROWS = 1_000_000
#: Accepted chance that the bands overlook one link at the threshold.
MISS = 1e-6


def shingle_set(text: str | None, ngram: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of ``text``, ASCII letters in lower case.

    Words are runs of anything but space and \\x09-\\x0D. With fewer than
    ``ngram`` words, but some, the whole sequence is the one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if 0 < len(words) < ngram:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(grams(hashes.of(words), ngram))


def plan_bands(values: int, threshold: Fraction) -> tuple[int, int]:
    """Bands and values a band: the longest bands that miss a link at the threshold at most ``MISS`` of the time."""
    for r in range(values, 0, -1):
        bands = values // r
        if (1 - float(threshold) ** r) ** bands <= MISS:
            return bands, r
    return values, 1


def signature(shingles: np.ndarray, factors: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """Minima, then maxima, of ``factor * shingle mod 2**64`` over the set."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(factors), np.uint64)
    for at in range(0, len(shingles), chunk):
        image = np.multiply.outer(factors, shingles[at : at + chunk])
        np.minimum(low, image.min(axis=1), out=low)
        np.maximum(high, image.max(axis=1), out=high)
    return np.concatenate([low, high])


def _features(ngram: int, perms: int, threshold: Fraction, seed: int):
    bands, r = plan_bands(2 * perms, threshold)
    factors = np.random.default_rng(seed).integers(1, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = np.random.default_rng(seed + 1).permutation(2 * perms)[: bands * r]  # mixes minima and maxima in a band

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sizes, keys, out = [], [], []
            for text in part.column(1).to_pylist():
                found = shingle_set(text, ngram, hashes)
                key = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                keys.append(((key >> 64) - 2**63, (key & (2**64 - 1)) - 2**63))
                out.append(signature(found, factors)[order] if len(found) else np.zeros(bands * r, np.uint64))
            block = np.array(out, np.uint64).reshape(-1, bands, r)
            value = np.zeros(block.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)
            for j in range(r):
                value = mix(value + block[:, :, j])
            flat = pa.array(value.view(np.int64).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return run


class Postings:
    """An inverted index of shingle sets, for exact overlaps of other sets with all of them."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        joined = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(joined, kind="stable")
        self.keys, self.owner = joined[order], owner[order]

    def overlaps(self, shingles: np.ndarray) -> np.ndarray:
        low = np.searchsorted(self.keys, shingles, "left")
        count = np.searchsorted(self.keys, shingles, "right") - low
        total = int(count.sum())
        if not total:
            return np.zeros(len(self.sizes), np.int64)
        starts = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return np.bincount(self.owner[starts + np.arange(total)], minlength=len(self.sizes))


def confirmed(left: list[np.ndarray], right: list[np.ndarray], threshold: Fraction) -> Iterator[tuple[int, np.ndarray]]:
    """For each left set, the right ones with ``|A & B| * den >= num * |A | B|``; counted on the full sets."""
    index = Postings(right)
    for i, shingles in enumerate(left):
        both = index.overlaps(shingles)
        union = len(shingles) + index.sizes - both
        yield i, np.flatnonzero((both * threshold.denominator >= threshold.numerator * union) & (both > 0))


def _links(rows: pa.Table) -> pa.Table:
    return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _verify_hub(ngram: int, threshold: Fraction):
    """One hub against one block of members."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes(100_000)
        ids, hub = group.column("node").to_pylist(), group.column("hub")[0].as_py()
        sets = [shingle_set(t, ngram, hashes) for t in group.column("text").to_pylist()]
        others = [i for i, x in enumerate(ids) if x != hub]
        at = [i for i, x in enumerate(ids) if x == hub][:1]
        found = []
        for _, js in confirmed([sets[i] for i in at], [sets[i] for i in others], threshold):
            found += [(hub, ids[others[j]]) for j in js]
        return _links(found)

    return run


def _verify_blocks(ngram: int, threshold: Fraction):
    """Two blocks of a cluster, or one with itself; a spanning forest of the links between different components."""

    def run(group: pa.Table) -> pa.Table:
        hashes = WordHashes(100_000)
        ids, label, side = (group.column(c).to_pylist() for c in ("node", "label", "side"))
        sets = [shingle_set(t, ngram, hashes) for t in group.column("text").to_pylist()]
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        left = [i for i, s in enumerate(side) if s == 0]
        right = [i for i, s in enumerate(side) if s == 1] or left
        found = []
        for i, js in confirmed([sets[i] for i in left], [sets[j] for j in right], threshold):
            for j in js:
                p, q = find(label[left[i]]), find(label[right[j]])
                if p != q:
                    root[p] = q
                    found.append((ids[left[i]], ids[right[j]]))
        return _links(found)

    return run


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint only for a counted number of rows; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _put(df: DataFrame, facts: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Left join to a written table of facts on the few hot ``keys``: broadcast after a count, else salted by ``by``."""
    if facts.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(facts), keys, "left")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*keys, "_salt"], "left").drop("_salt")


def near_dedup(docs: DataFrame, ngram: int = 5, threshold: Fraction = Fraction(4, 5), perms: int = 128, seed: int = 7) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``.

    Returns one row for each input row: ``doc_id, n_shingles, class_id,
    component_id, kept``. ``class_id`` is the smallest doc_id with the same set,
    ``component_id`` the smallest doc_id reachable over links of at least
    ``threshold``, ``kept`` whether that is the row's own doc_id.

    Null, empty or blank text: no shingles, linked with nothing, kept. Null
    doc_id: never linked, class and component null, kept. Repeated rows: each is
    returned, placed by its own text; rows of one doc_id and equal text agree.
    Empty table: no rows. The number of texts in a group has no limit.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    with scratch_scope() as made:
        out = materialize(_near_dedup(docs, ngram, threshold, perms, seed), "near-dedup")
    release(docs.sparkSession, made[:-1])  # all but the result
    return out


def _near_dedup(docs: DataFrame, ngram: int, threshold: Fraction, perms: int, seed: int) -> DataFrame:
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
    feats = materialize(docs.mapInArrow(_features(ngram, perms, threshold, seed), schema), "features")
    named = feats.where("n_shingles > 0 and doc_id is not null")
    classes = materialize(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    members = materialize(_members(classes.select("node", "n", F.explode("bands").alias("h"))), "members")
    num, den = threshold.numerator, threshold.denominator
    fits = F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num  # sets of other sizes cannot reach the threshold
    stars = materialize(members.where((F.col("node") != F.col("hub")) & fits).select("hub", "node").distinct(), "stars")
    wanted = materialize(members.select("node").distinct(), "wanted")
    texts = _texts(docs, wanted)

    found = _check_stars(stars, texts, ngram, threshold)
    rest = _check_rest(members, components(found), texts, ngram, threshold)
    final = components(found.unionAll(rest))

    labels = classes.select("k1", "k2", "node").join(final, "node", "left").select("k1", "k2", "node", F.coalesce("component", "node").alias("component"))
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    out = feats.select("doc_id", "n_shingles", F.when(own, F.col("k1")).alias("k1"), F.when(own, F.col("k2")).alias("k2")).join(labels, ["k1", "k2"], "left")
    return out.select(
        "doc_id",
        "n_shingles",
        F.coalesce("node", "doc_id").alias("class_id"),
        F.coalesce("component", "doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id"))).alias("kept"),
    )


def _members(hits: DataFrame) -> DataFrame:
    """``h, node, n, hub, hub_n`` of the buckets with two members or more; the rows of large buckets are not shuffled."""
    hubs = materialize(hits.groupBy("h").agg(F.min(F.struct("node", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1"), "hubs")
    columns = ["h", "node", "n", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")]
    large = hubs.where(F.col("c") > BLOCK)
    if large.isEmpty():
        return hits.join(hubs, "h").select(columns)
    marked = _put(hits, large, ["h"], "node")
    rest = marked.where("hub is null").select("h", "node", "n").join(hubs.where(F.col("c") <= BLOCK), "h")
    return marked.where("hub is not null").select(columns).unionByName(rest.select(columns))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the nodes that share a bucket, each once."""
    side = _small(wanted, wanted.count())
    found = docs.withColumnRenamed("doc_id", "node").join(side, "node")
    return materialize(found, "texts")


def _check_stars(stars: DataFrame, texts: DataFrame, ngram: int, threshold: Fraction) -> DataFrame:
    many = materialize(stars.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1"), "hot-hubs")
    dealt = _put(stars, many, ["hub"], "node").select("hub", "node", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    heads = dealt.select("hub", "block").distinct().select("hub", F.col("hub").alias("node"), "block")
    groups = dealt.unionByName(heads).join(texts, "node").groupBy("hub", "block")
    return materialize(groups.applyInArrow(_verify_hub(ngram, threshold), "a long, b long"), "found")


def _check_rest(members: DataFrame, comp: DataFrame, texts: DataFrame, ngram: int, threshold: Fraction) -> DataFrame:
    """Links between members of one bucket that the hubs did not connect."""
    left = members.where("node != hub").join(comp, "node", "left").select("h", "node", F.coalesce("component", "node").alias("label"))
    open_ = materialize(left.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("first")).where("lo != hi").select("h", "first"), "open-buckets")
    rows = materialize(left.join(_small(open_, open_.count()), "h"), "open")
    cluster = components(rows.select(F.col("first").alias("a"), F.col("node").alias("b")))
    nodes = rows.select("node", "label").distinct().join(cluster, "node").select(F.col("component").alias("g"), "node", "label")
    nodes, wide = _narrow(materialize(nodes, "clusters"))
    if not wide.isEmpty():
        chosen = wide.select("node").distinct()
        inside = rows.join(_small(chosen, wide.count()), "node", "left_semi")
        buckets, wide = _narrow(_distinct_groups(inside.select(F.col("h").alias("g"), "node", "label")))
        nodes = nodes.unionByName(buckets)
        if not wide.isEmpty():
            nodes = nodes.unionByName(_distinct_groups(_by_rare_shingles(wide, texts, ngram, threshold)))
    return _check_groups(nodes, texts, ngram, threshold)


def _narrow(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows ``g, node, label`` of groups that may be compared as one, and those of the others."""
    size = groups.groupBy("g", "label").agg(F.count("*").alias("c")).groupBy("g").agg((F.sum("c") - F.max("c")).alias("others"))
    wide = materialize(size.where(F.col("others") > NARROW).select("g"), "wide")
    if wide.isEmpty():
        return groups, groups.limit(0)
    marked = materialize(_put(groups, wide.withColumn("wide", F.lit(True)), ["g"], "node"), "marked")
    return marked.where("wide is null").drop("wide"), marked.where("wide").drop("wide")


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """Of groups with equal sets of members only the one of the smallest ``g``; groups of one component are left out."""
    groups = materialize(groups, "groups")
    prints = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("c")]
    sets = groups.groupBy("g").agg(*prints, F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    kept = materialize(sets.groupBy("x", "y", "c").agg(F.min("g").alias("g")).select("g"), "kept-groups")
    return materialize(groups.join(_small(kept, kept.count()), "g", "left_semi"), "groups")


def _shingles_of(ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in slices(batches):
            sets = [shingle_set(t, ngram, hashes).view(np.int64) for t in part.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "shingles"])

    return run


def _by_rare_shingles(groups: DataFrame, texts: DataFrame, ngram: int, threshold: Fraction) -> DataFrame:
    """Groups of the members of a wide group that share one of their rarest shingles there.

    Of two sets whose similarity is at least t, each put in the same order, the
    first ``n - ceil(t * n) + 1`` have a member in common; so no link is lost.
    Shingles in at least ``BLOCK`` members come last, by their number; of those
    there is at most one for ``BLOCK`` rows.
    """
    num, den = threshold.numerator, threshold.denominator
    sets = materialize(texts.join(groups.select("node").distinct(), "node", "left_semi").select("node", "text").mapInArrow(_shingles_of(ngram), "node long, shingles array<long>"), "sets")
    rows = groups.join(sets, "node").select("g", "node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = materialize(rows.groupBy("g", "s").agg(F.count("*").alias("c")).where(F.col("c") >= BLOCK), "often")
    ranked = _put(rows, often, ["g", "s"], "node").withColumn("place", F.row_number().over(Window.partitionBy("g", "node").orderBy(F.coalesce("c", F.lit(0)), "s")))
    first = ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    return first.select(F.xxhash64("g", "s").alias("g"), "node", "label")


def _check_groups(nodes: DataFrame, texts: DataFrame, ngram: int, threshold: Fraction) -> DataFrame:
    """Confirmed links between the different labels of each group of ``g, node, label``."""
    # components of a block or more have blocks of their own, so that two of these can be skipped; the others share blocks
    big = materialize(nodes.groupBy("g", "label").agg(F.count("*").alias("size")).where(F.col("size") >= BLOCK), "big-labels")
    sized = _put(nodes, big, ["g", "label"], "node")
    small = materialize(sized.where("size is null").groupBy("g").agg(F.count("*").alias("small")).where(F.col("small") > BLOCK), "small-labels")
    count = F.ceil(F.coalesce("size", "small", F.lit(1)) / BLOCK)
    own = F.when(F.col("size").isNotNull(), F.col("label"))
    key = F.struct(F.coalesce(own, F.lit(NO_OWNER)).alias("own"), F.pmod(F.xxhash64("node"), count).cast("int").alias("block"))
    keyed = materialize(_put(sized, small, ["g"], "node").select("g", "node", "label", key.alias("key")), "blocks")
    ends = keyed.select("g", "key").distinct()
    other = ends.withColumnRenamed("key", "other")
    tasks = ends.join(other, "g").where((F.col("key") <= F.col("other")) & ((F.col("key.own") != F.col("other.own")) | (F.col("key.own") == NO_OWNER)))
    tasks = tasks.withColumn("task", F.xxhash64("g", "key", "other"))
    sides = tasks.select("g", "task", "key", F.lit(0).alias("side")).unionAll(tasks.where("key != other").select("g", "task", F.col("other").alias("key"), F.lit(1).alias("side")))
    groups = keyed.join(sides, ["g", "key"]).select("task", "side", "node", "label").join(texts, "node").groupBy("task")
    return materialize(groups.applyInArrow(_verify_blocks(ngram, threshold), "a long, b long"), "rest")


def deduplicated(docs: DataFrame, ngram: int = 5, threshold: Fraction = Fraction(4, 5)) -> DataFrame:
    """One document of each component, with all its columns: the one of the smallest doc_id.

    Rows without shingles or doc_id stay. Of rows that repeat a doc_id and its
    text one stays; rows that repeat a doc_id with other texts stay or go by
    their own texts' components.
    """
    pairs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    found = near_dedup(pairs, ngram, threshold)
    gone = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")), "decided")
    dropped, repeated = gone.where("not kept").select("doc_id"), gone.where("kept and rows > 1").select("doc_id")
    names = quoted(docs.columns)
    kept = docs.join(_small(dropped, dropped.count()), "doc_id", "left_anti").select(names)
    if repeated.isEmpty():
        return kept
    side = _small(repeated, repeated.count())
    once = kept.join(side, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(side, "doc_id", "left_anti").select(names).unionAll(once.select(names))


#: DuckDB SQL of the query's columns: equal sets once, pairs by common shingles, then the closure of the links.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS g FROM d),
c AS (SELECT min(doc_id) AS class, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
u AS (SELECT class, n, unnest(g) AS h FROM c),
p AS (SELECT a.class AS x, b.class AS y FROM u a JOIN u b ON a.h = b.h AND a.class <> b.class AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(class, root) AS (SELECT class, class FROM c UNION SELECT y, root FROM r JOIN p ON class = x),
m AS (SELECT class, min(root) AS root FROM r GROUP BY class)
SELECT doc_id, len(s.g) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m USING (class)"""
