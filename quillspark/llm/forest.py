"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Every distinct set of word n-grams gets one MinHash label in each tree. Sorting the labels of a tree
lays its prefix trie out flat: texts that share a prefix stand together, and how much neighbours
share tells the runs of every depth at once. A text starts with its full labels, which it shortens
value by value, in trees with short runs first, until the recall that its own prefixes give reaches
the target; where many texts share a prefix, next values go on splitting them. Texts that meet under
the prefix of either become candidate components, and within those every pair is verified on the
full n-gram sets, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Hashes, Held, Sieve, cut, few_files, map_text, word_hashes
from quillspark.llm.components import components

MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: str | None, n: int, known: Hashes) -> np.ndarray:
    """Distinct hashes of the word n-grams, sorted; a text of fewer words is one n-gram, one of none has none."""
    words = word_hashes(text or "", known)
    if not len(words):
        return words
    size = min(n, len(words))
    h = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        h = (h ^ words[i : len(words) - size + 1 + i]) * MIX
        h ^= h >> np.uint64(29)
    return np.unique(h)


def gram_bytes(n: int) -> Callable[[list], list[list]]:
    """A function from texts to their n-grams as bytes."""
    known = Hashes()
    return lambda texts: [[ngrams(t, n, known).tobytes() for t in texts]]


def permutations(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.RandomState(seed)
    a = r.randint(0, 1 << 32, count, np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, count, np.uint64) | np.uint64(1)
    return a, r.randint(0, 1 << 32, count, np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, count, np.uint64)


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 256) -> np.ndarray:
    """16 bits of the smallest value of each permutation, a few n-grams by all permutations at a time."""
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for at in range(0, len(grams), step):
        values = np.multiply.outer(grams[at : at + step], a)
        values += b
        np.minimum(least, values.min(axis=0), out=least)
    # The upper bits of a minimum are mostly zeros, so they are mixed first.
    return (least * MIX >> np.uint64(48)).astype(np.uint16)


def chance(depth: int, trees: int, similarity: float) -> float:
    """The chance that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def adapted_depth(full: int, trees: int, similarity: float, recall: float) -> int:
    """The longest prefix that reaches the recall if all trees use it: the full label, shortened step by step."""
    depth = full
    while depth > 1 and chance(depth, trees, similarity) < recall:
        depth -= 1
    return depth


def sketches(docs: DataFrame, n: int, trees: int, full: int) -> DataFrame:
    """doc_id, text_key, digest of the n-gram set (null if empty), text_hash, size of the set and a label a tree."""

    def make() -> Callable[[list], list[list]]:
        known, (a, b) = Hashes(), permutations(trees * full)

        def work(texts: list) -> list[list]:
            out: list[list] = [[], [], [], []]
            for t in texts:
                grams = ngrams(t, n, known)
                out[0].append(xxhash.xxh3_128_digest(grams.tobytes()) if len(grams) else None)
                out[1].append(None if t is None else xxhash.xxh3_128_digest(t))
                out[2].append(len(grams))
                # Big-endian, so that labels sort by their first value first.
                out[3].append([x.tobytes() for x in minhash(grams, a, b).astype(">u2").reshape(trees, full)] if len(grams) else [])
            return out

        return work

    fields = [("digest", "binary", pa.binary()), ("text_hash", "binary", pa.binary()), ("grams", "int", pa.int32()), ("labels", "array<binary>", pa.list_(pa.binary()))]
    return map_text(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), ["doc_id", "text_key"], make, fields)


def fixed(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of values of one width as a matrix of bytes."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width)


class Trie:
    """Rows (tree, label, digest, ...) of one partition, sorted: a stretch of the laid-out tries."""

    def __init__(self, batches: list[pa.RecordBatch], full: int) -> None:
        self.tree = np.concatenate([b.column(0).to_numpy() for b in batches])
        self.label = np.concatenate([fixed(b.column(1), 2 * full) for b in batches])
        self.digest = np.concatenate([fixed(b.column(2), 16) for b in batches])
        values = self.label.reshape(len(self.label), full, 2)
        same = np.logical_and.accumulate((values[1:] == values[:-1]).all(axis=2), axis=1).sum(axis=1)
        #: Values that a row shares with the one before it; -1 at the first row and between trees.
        self.shared = np.concatenate([[-1], np.where(self.tree[1:] == self.tree[:-1], same, -1)])

    def runs(self, depth: int) -> np.ndarray:
        """The number of each row's run under prefixes of this depth."""
        return np.cumsum(self.shared < depth) - 1

    def border(self, depth: int) -> np.ndarray:
        """Rows of the first and the last run, which may go on in other partitions."""
        run = self.runs(depth)
        return (run == 0) | (run == run[-1])


def laid_out(labels: DataFrame, rows: int) -> DataFrame:
    """``labels`` (tree, label, digest, ...) in range partitions, sorted; hot prefixes are cut anywhere."""
    parts = max(1, int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))
    return labels.repartitionByRange(parts, "tree", "label", "digest").sortWithinPartitions("tree", "label", "digest")


def matched(labels: DataFrame, rows: int, full: int, least: int) -> DataFrame:
    """Rows of ``labels`` that share a prefix of ``least`` values, with ``sizes`` of their runs at ``least`` and all greater depths.

    A run that a border of partitions cuts counts in each by what is there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        trie, table = Trie(got, full), pa.Table.from_batches(got)
        sizes = np.stack([np.bincount(r)[r] for r in map(trie.runs, range(least, full + 1))], axis=1).astype(np.int32)
        use = np.flatnonzero((sizes[:, 0] > 1) | trie.border(least))
        size = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32) * sizes.shape[1]), pa.array(sizes[use].ravel()))
        for b in table.take(pa.array(use)).append_column("sizes", size).combine_chunks().to_batches():
            yield b

    return laid_out(labels, rows).mapInArrow(run, "tree int, label binary, digest binary, sizes array<int>")


def shortened(sizes: np.ndarray, full: int, least: int, similarity: float, recall: float, hot: int) -> np.ndarray:
    """Prefix depths (texts, trees) of texts whose runs have these ``sizes`` (texts, trees, depths from ``least`` to ``full``).

    The recall of a pair at ``similarity`` is 1 less the product over the trees of the chance that the
    prefixes differ. All trees start with full labels. Value by value prefixes are shortened until the
    recall is reached: first where the run of the shorter prefix has up to ``hot`` members, in the order
    of the trees, since preferring the emptier of short runs would prefer trees in which a partner is
    missing; then in all others, shorter runs first.
    """
    n, trees, _ = sizes.shape
    gain = [-math.log(1 - similarity**d) for d in range(full + 1)[1:]]  # by depth, from 1
    depth = np.full((n, trees), full)
    missing = np.full(n, -math.log(1 - recall) - trees * gain[full - 1])
    for last in (False, True):
        for d in range(full - 1, least - 1, -1):
            size = sizes[:, :, d - least]
            free = depth == d + 1
            if not last:
                free &= size <= hot
            step = gain[d - 1] - gain[d]
            need = np.ceil(np.maximum(missing, 0) / step - 1e-9)
            order = np.where(free, size if last else 0, np.iinfo(np.int32).max).argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
            take = free & (order < need[:, None])
            depth[take] = d
            missing = missing - take.sum(axis=1) * step
    return depth


def chosen(rows: DataFrame, trees: int, full: int, least: int, similarity: float, recall: float, hot: int) -> DataFrame:
    """Matched ``rows`` with the depth of the prefix that their text chooses in each tree; trees without a match count as runs of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            batch = table.to_batches()[0]
            digest = fixed(batch.column(2), 16)
            new = np.concatenate([[True], (digest[1:] != digest[:-1]).any(axis=1)])
            # The last text may go on in the next batch.
            end = len(new) if last else int(np.flatnonzero(new)[-1])
            held[:] = [] if last else [batch.slice(end)]
            if not end:
                return
            text = np.cumsum(new[:end]) - 1
            sizes = np.ones((text[-1] + 1, trees, full - least + 1), np.int32)
            tree = batch.column(0).to_numpy()[:end]
            sizes[text, tree] = np.asarray(batch.column(3).flatten())[: end * sizes.shape[2]].reshape(end, -1)
            depth = shortened(sizes, full, least, similarity, recall, hot)[text, tree]
            part = batch.slice(0, end)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(depth.astype(np.int32))], names=["tree", "label", "digest", "depth"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 50_000:
                yield from made(False)
        if held:
            yield from made(True)

    return rows.repartition("digest").sortWithinPartitions("digest", "tree").mapInArrow(run, "tree int, label binary, digest binary, depth int")


def meetings(rows: DataFrame, count: int, full: int, least: int, held: Held) -> DataFrame:
    """Edges (a, b) that join all digests that meet: those that share the prefix which one of them chooses.

    ``rows`` (tree, label, digest, depth) are sorted again. Neighbours are joined if a run that holds
    both is chosen by one of its members. Of each stretch the members point to the smallest. Runs that
    a border of partitions cuts are joined as a whole, by their prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := [b for b in batches if b.num_rows]):
            return
        trie, depth = Trie(got, full), np.concatenate([b.column(3).to_numpy() for b in got])
        border, joined = trie.border(least), np.zeros(len(depth), bool)
        for d in range(least, full + 1):
            number = trie.runs(d)
            joined |= (trie.shared >= d) & (np.bincount(number, depth == d)[number] > 0)
        joined |= border & (trie.shared >= least)
        stretch = np.cumsum(~joined) - 1
        # The smallest digest of each stretch, by both halves as whole numbers.
        halves = np.ascontiguousarray(trie.digest).view(">u8").astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0], stretch))
        head = order[np.flatnonzero(np.diff(stretch[order], prepend=-1))][stretch]
        member = np.flatnonzero(head != np.arange(len(head)))
        digest = [x.tobytes() for x in trie.digest]
        for at in range(0, len(member), 50_000):
            part = member[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in head[part]], pa.binary()), pa.array([digest[i] for i in part], pa.binary()), pa.nulls(len(part), pa.binary())], names=["a", "b", "run"])
        ends = np.unique(head[border])
        keys = [int(trie.tree[i]).to_bytes(4, "big") + trie.label[i, : 2 * least].tobytes() for i in ends]
        yield pa.RecordBatch.from_arrays([pa.array([digest[i] for i in ends], pa.binary()), pa.nulls(len(ends), pa.binary()), pa.array(keys, pa.binary())], names=["a", "b", "run"])

    made = held(laid_out(rows, count).mapInArrow(run, "a binary, b binary, run binary"))
    # One or two rows a partition, whatever the data.
    cut_runs = made.where("run IS NOT NULL").select("a", "run")
    over = cut_runs.join(cut_runs.groupBy("run").agg(F.min("a").alias("b")), "run").where("a != b").select("a", "b")
    return made.where("run IS NULL").select("a", "b").unionByName(over)


def common_counts(rows: np.ndarray, columns: np.ndarray, left: int, total: int) -> np.ndarray:
    """How many columns each of the first ``left`` sets shares with each of the others, of entries (row, column) of ``total`` sets.

    With ``left`` equal to ``total`` the sets are compared with themselves. Columns of many sets are
    multiplied as a matrix, the others are listed pair by pair, so the work follows what is shared.
    """
    start = left if left < total else 0
    count = np.zeros((left, total - start), np.float32)
    on_left, on_right = rows < left, rows >= start
    n = int(columns.max(initial=-1)) + 1
    a, b = np.bincount(columns[on_left], minlength=n), np.bincount(columns[on_right], minlength=n)
    dense = a * b > count.size // 100
    order = np.flatnonzero(dense)
    place = np.full(n, -1)
    place[order] = np.arange(len(order))
    for at in range(0, len(order), 1024):
        sides = []
        for own, low, size in ((on_left, 0, left), (on_right, start, total - start)):
            own = own & (place[columns] >= at) & (place[columns] < at + 1024)
            side = np.zeros((size, min(1024, len(order) - at)), np.float32)
            side[rows[own] - low, place[columns[own]] - at] = 1
            sides.append(side)
        count += sides[0] @ sides[1].T
    own = np.flatnonzero(on_left & ~dense[columns] & (b[columns] > 0))
    other = np.flatnonzero(on_right & ~dense[columns])
    other = other[np.argsort(columns[other], kind="stable")]
    first = np.searchsorted(columns[other], np.arange(n))
    ends, begin = np.cumsum(b[columns[own]]), 0
    while begin < len(own):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 21), "right")))
        part = own[begin:stop]
        times = b[columns[part]]
        where = np.repeat(first[columns[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
        np.add.at(count, (np.repeat(rows[part], times), rows[other[where]] - start), 1)
        begin = stop
    return count


def link_counts(sets: list[np.ndarray], weight: np.ndarray, split: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set, as a sum of its partners' weights (columns of ``weight``), and the smallest linked index.

    With ``split`` the pairs between the first ``split`` sets and the others count; with 0 all pairs.
    """
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    rows = np.repeat(np.arange(m), sizes)
    _, columns, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[columns] > 1  # what is in one set only is common to none
    rows, columns = rows[use], np.unique(columns[use], return_inverse=True)[1]
    left, start = split or m, split
    common = common_counts(rows, columns, left, m).astype(np.float64)
    hit = common >= threshold * (sizes[:left, None] + sizes[None, start:] - common) - 1e-9
    if not split:
        hit = np.triu(hit, 1)
    links, weight = np.zeros((m, weight.shape[1])), weight.astype(np.float64)
    links[:left] += hit @ weight[start:]
    links[start:] += hit.T @ weight[:left]
    root = np.arange(m)
    for i in np.flatnonzero(hit.any(axis=1)):
        near = root[np.flatnonzero(hit[i]) + start]
        if (near != root[i]).any():
            merged = np.unique(np.append(near, root[i]))
            root[np.isin(root, merged)] = merged[0]
    return links.astype(np.int64), root


#: Rows of a partition of a laid-out trie at most, on average.
ROWS = 400_000
#: Runs of up to so many members are short: prefixes are shortened in their trees first.
HOT = 64
#: A component is cut into this many blocks, where they still hold a 32nd of a block each, so that hundreds of groups share it.
SPREAD = 32
#: Members of small components that make a group, on average.
GROUP = 512
#: Tasks that deal the members of a large component out to its blocks.
SALTS = 64


def jaccard_join(
    docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, full: int = 7, recall: float = 0.9999, block_docs: int = 2048, block_grams: int = 1_000_000
) -> DataFrame:
    """Joins ``docs`` (doc_id, text) with itself where word n-gram sets have a Jaccard index of ``threshold`` or more.

    Returns one row for each row of ``docs``: doc_id, class_id (the smallest doc_id that links lead
    to, its own if none), n_links (other rows it is similar to, copies included), n_text_links (other
    texts it is similar to) and n_copies (other rows with the same n-grams).

    Words are runs of letters and digits in lower case. Texts of fewer than ``n`` words are one
    n-gram. Texts without words, and null texts, are similar to nothing. Rows without doc_id take no
    part and get null, 0, 0, 0. Rows that repeat a doc_id, with the same text or another, count as
    rows of their own in n_links; ties in class names go to the text that hashes lowest. Very long
    texts are compared whole. An empty table gives an empty one. Other columns are not read.

    Equal sets meet once, so copies cost a count. A pair at exactly the threshold is missed with a
    chance of 1 - ``recall``, as its texts' own prefixes give it: at most ``chance(full, trees,
    threshold)`` is certain where all its runs are hot, since texts choose by what their runs hold.
    Pairs of one candidate component are all verified, met or not. A component of many members is cut
    into blocks of at most about ``block_docs`` sets or ``block_grams`` n-grams, and each pair of
    blocks is a group of its own, to which the n-grams of both go.
    """
    rows = classified(docs, n, threshold, trees, full, recall, block_docs, block_grams)
    return rows.select("doc_id", "class_id", "n_links", "n_text_links", "n_copies")


def classified(docs: DataFrame, n: int, threshold: float, trees: int, full: int, recall: float, block_docs: int, block_grams: int) -> DataFrame:
    """The rows of :func:`jaccard_join` with text_key, the hash of their text, and class_key, that of the row after which the class is named."""
    sketch = cut(sketches(docs, n, trees, full), "sketches")
    known = sketch.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    texts = known.groupBy("digest", "text_hash").agg(F.min(F.struct("doc_id", "text_key")).alias("head"), F.count(F.lit(1)).alias("n_docs"), F.min("grams").alias("grams"), F.first("labels").alias("labels"))
    sets = texts.groupBy("digest").agg(F.min("head").alias("head"), F.sum("n_docs").alias("n_docs"), F.count(F.lit(1)).alias("n_texts"), F.min("grams").alias("grams"), F.first("labels").alias("labels"))
    total = sketch.count()
    held = Held()
    sets = held(sets.withColumns({"rep": F.col("head.doc_id"), "rep_key": F.col("head.text_key")}), total)

    least = max(1, adapted_depth(full, trees, threshold, recall) - 1)
    labels = sets.select("digest", F.posexplode("labels").alias("tree", "label")).select("tree", "label", "digest")
    found = held(matched(labels, total * trees, full, least))
    count = found.count()
    edges = meetings(chosen(found, trees, full, least, threshold, recall, HOT), count, full, least, held)
    joined = components(edges, count)
    found = joined.count()
    member = held(joined.join(sets, joined["v"] == sets["digest"]).select("digest", "comp", "rep", "rep_key", "n_docs", "n_texts", "grams"), found)
    spread = F.least(F.lit(SPREAD), F.ceil(F.count(F.lit(1)) * 32 / block_docs))
    sizes = held(member.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_docs), F.ceil(F.sum("grams") / block_grams), spread).cast("int").alias("blocks")), found)
    # Only components of several blocks need their number; salts deal the members of each out.
    salted = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = member.withColumn("salt", F.pmod(F.xxhash64("digest", F.lit(2)), F.lit(SALTS)).cast("int"))
    placed = dealt.join(salted, ["comp", "salt"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("digest", F.lit(1)), "blocks").cast("int"))
    pairs = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("digest", "comp", "rep", "rep_key", "n_docs", "n_texts", "blocks", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "i")
    pairs = pairs.withColumn("group", F.xxhash64("comp", "lo", "hi"))
    body = docs.select(F.col("doc_id").alias("rep"), F.xxhash64("text").alias("rep_key"), "text").where("rep IS NOT NULL")
    # Texts become n-grams where they are read, once, however many groups they go to.
    sets_of = map_text(body, ["rep", "rep_key"], lambda: gram_bytes(n), [("set", "binary", pa.binary())], sieve=(Sieve(member.select("rep")), "rep"))
    sets_of = sets_of.join(member.select("rep", "rep_key"), ["rep", "rep_key"], "left_semi").dropDuplicates(["rep", "rep_key"])
    # Small components share groups, so that a group has work enough.
    many = F.greatest(F.lit(1), F.ceil(F.lit(found) / GROUP)).cast("bigint")
    group = F.when(F.col("blocks") > 1, F.xxhash64("comp", "lo", "hi")).otherwise(F.pmod(F.xxhash64("comp"), many))
    rows = pairs.join(sets_of, ["rep", "rep_key"]).select(group.alias("group"), "comp", "lo", "hi", "i", "digest", "n_docs", "n_texts", "set")

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "lo", "hi", "i", "digest"], ignore_index=True)
        comp, lo, hi, i = (pdf[c].to_numpy() for c in ("comp", "lo", "hi", "i"))
        starts = np.flatnonzero(np.concatenate([[True], (comp[1:] != comp[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])]))
        grams = [np.frombuffer(x, np.uint64) for x in pdf["set"]]
        weight, use = pdf[["n_docs", "n_texts"]].to_numpy(np.int64), np.ones(len(pdf), bool)
        links, root = np.zeros_like(weight), np.arange(len(pdf))
        for a, b in zip(starts, [*starts[1:], len(pdf)], strict=True):
            first = int((i[a:b] == lo[a]).sum()) if lo[a] != hi[a] else 0
            if lo[a] != hi[a] and first in (0, b - a):
                use[a:b] = False
                continue
            links[a:b], own = link_counts(grams[a:b], weight[a:b], first, threshold)
            root[a:b] = own + a
        digests = pdf["digest"].to_numpy()
        return pd.DataFrame({"digest": digests, "n_links": links[:, 0], "n_text_links": links[:, 1], "root": digests[root]})[use]

    verified = held(rows.groupBy("group").applyInPandas(verify, "digest binary, n_links bigint, n_text_links bigint, root binary"))
    counts = verified.groupBy("digest").agg(F.sum("n_links").alias("links"), F.sum("n_text_links").alias("text_links"))
    classes = components(verified.select(F.col("digest").alias("a"), F.col("root").alias("b")).where("a != b"), verified.count())
    named = held(classes.join(sets.select(F.col("digest").alias("v"), "head"), "v"), found)
    ids = held(named.groupBy("comp").agg(F.min("head").alias("class")), found)
    named = named.join(ids, "comp").select(F.col("v").alias("digest"), "class")
    result = sets.drop("labels").join(counts, "digest", "left").join(named, "digest", "left")
    result = cut(
        result.select(
            F.col("digest").alias("key"),
            F.coalesce("class", "head").alias("class"),
            (F.coalesce("links", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"),
            (F.coalesce("text_links", F.lit(0)) + F.col("n_texts") - 1).alias("n_text_links"),
            (F.col("n_docs") - 1).alias("n_copies"),
        ),
        "result",
        total,
    )
    held.release()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    usable = F.when(F.col("doc_id").isNotNull(), F.col("digest"))
    final = (
        sketch.select("doc_id", "text_key", usable.alias("digest"))
        .join(result, F.col("digest") == F.col("key"), "left")
        .withColumn("class", F.coalesce("class", F.struct("doc_id", "text_key")))
        .select("doc_id", "text_key", F.col("class.doc_id").alias("class_id"), F.col("class.text_key").alias("class_key"), zero("n_links"), zero("n_text_links"), zero("n_copies"))
    )
    return few_files(final, total)


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, trees: int = 24, full: int = 7, recall: float = 0.9999, block_docs: int = 2048, block_grams: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class the row with the smallest doc_id stays.

    All columns are kept. Rows without doc_id, and texts without words, are in no class and stay, but
    of rows that repeat a doc_id with the same text one stays. Rows that repeat a doc_id with another
    text are judged each by its text; of those in one class, the one whose text hashes lowest stays.
    Null and empty texts stay, very long ones are compared whole; an empty table gives an empty one.

    Only rows that a filter can't clear are shuffled: those to drop, and those that repeat an id.
    """
    found = classified(docs, n, threshold, trees, full, recall, block_docs, block_grams).where("doc_id IS NOT NULL")
    stays = (F.col("doc_id") == F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    per_text = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(F.min(stays).alias("__stays"), F.count(F.lit(1)).alias("__times"))
    odd = cut(per_text.where("NOT __stays OR __times > 1"), "dropped")
    touched = Sieve(odd.select("__id")).may_hold("doc_id")
    rest = docs.where(touched).join(odd, (F.col("doc_id") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
    once = rest.where("__id IS NULL").select(docs.columns)
    again = rest.where("__stays AND __times > 1").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return docs.where(~touched).unionByName(once).unionByName(again)
