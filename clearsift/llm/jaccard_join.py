"""N-gram Jaccard join: prefix trees over globally ordered shingle sets, pruned by remaining-length bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii, words
from .components import connected_components
from .windows import mix, pieces, run_hashes, starts_of_runs

_U = np.uint64
#: Documents and elements of a block, on average; a candidate group larger than this is split into blocks that meet in pairs.
_BLOCK_DOCS, _BLOCK_ELEMENTS = 512, 1 << 18
#: Seeds of the two digests of a set.
_SEEDS = (0x5851F42D, 0x14057B7E)


def shingle_sets(h: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each document, in ascending order, end to end, and how many each has.

    A document with fewer than `width` words has one shingle, its whole sequence; one without words has none.
    """
    rows = np.repeat(np.arange(len(lengths)), lengths)
    inside = starts_of_runs(lengths, width)
    grams, owners = run_hashes(h, width)[inside], rows[inside]
    short = np.flatnonzero((lengths > 0) & (lengths < width))
    if len(short):
        first = (np.cumsum(lengths) - lengths)[short]
        whole = np.array([mix(run_hashes(h[a : a + n], n)[:1] + _U(n))[0] for a, n in zip(first, lengths[short], strict=True)], np.uint64)
        grams, owners = np.append(grams, whole), np.append(owners, short)
    order = np.lexsort((grams, owners))
    grams, owners = grams[order], owners[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owners[1:] != owners[:-1])
    return grams[new], np.bincount(owners[new], minlength=len(lengths)).astype(np.int64)


def _lists(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    h = batch.column("h")
    lengths = np.asarray(h.value_lengths().fill_null(0), dtype=np.int64)
    return shingle_sets(np.asarray(h.flatten(), dtype=np.int64), lengths, width)


def _per_row(x: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit numbers by row, modulo 2**64 but for the exact halves."""
    low = np.bincount(rows, (x & _U(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(rows, (x >> _U(32)).astype(np.float64), n).astype(np.uint64)
    return low + high * _U(0x9E3779B97F4A7C15)


def _hashed(docs: DataFrame, *keep: str) -> DataFrame:
    return docs.select("doc_id", *keep, F.transform(words(lower_ascii(F.col("text"))), lambda w: F.xxhash64(w)).alias("h"))


def _digest(grams: np.ndarray, rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A digest of each set, whatever the order of its elements."""
    return mix(_per_row(mix(grams ^ _U(seed)), rows, n)).view(np.int64)


def least_common(n, percent: int):
    """The least number of elements that a set of n elements has in common with any set linked with it."""
    return (percent * n + 99) // 100


def asked(n, share: int):
    """The number of common elements that extended prefixes are made for, by set size: `share` percent, at least one."""
    return np.maximum(1, n * share // 100)


def set_table(docs: DataFrame, width: int, percent: int, share: int = 10) -> DataFrame:
    """doc_id, n_shingles, two digests c1 and c2 of the shingle set, and its prefix grams with most and k, in one pass.

    Equal sets have equal digests. The prefix holds the first elements in one global order, that of the hashes: linked
    sets x and y have least_common elements in common at least, so that the first l common ones lie among the first
    n - least_common(n) + l of each. With l = asked(n), the prefixes of x and y have at least min(asked(|x|),
    asked(|y|)) elements in common. `most` is the prefix's size, and k a lower bound of that minimum for any partner.
    Of equal sets in a batch one gives its prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, counts = _lists(batch, width)
            rows = np.repeat(np.arange(len(counts)), counts)
            c1, c2 = (_digest(grams, rows, len(counts), s) for s in _SEEDS)
            once = np.zeros(len(counts), bool)
            once[np.unique(c1, return_index=True)[1]] = True
            most = np.where(once & (counts > 0), counts - least_common(counts, percent) + asked(counts, share), 0)
            taken = np.arange(len(grams)) - np.repeat(np.cumsum(counts) - counts, counts) < most[rows]
            prefixes = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(most)).astype(np.int32)), pa.array(grams[taken].view(np.int64)))
            k = asked(least_common(counts, percent), share)
            columns = [batch.column("doc_id"), pa.array(counts), pa.array(c1), pa.array(c2), pa.array(most.astype(np.int32)), pa.array(k.astype(np.int32)), prefixes]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "c1", "c2", "most", "k", "grams"])

    return _hashed(docs).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, most int, k int, grams array<long>")


def rarest(elements: DataFrame, held: DataFrame, kept: Column) -> DataFrame:
    """(gram, c1): of each set's elements (gram, c1 and others) those in `held`, rare ones first, `kept` of them.

    `held` gives elements of more than one row with their frequency df. The join is a plain one of two exchanges, which
    Spark splits where an element is hot; what is gathered of a set are its own elements.
    """
    others = [F.first(c).alias(c) for c in elements.columns if c not in ("gram", "c1")]
    common = elements.join(held, "gram").groupBy("c1").agg(F.sort_array(F.collect_set(F.struct("df", "gram"))).alias("es"), *others)
    first = common.select("c1", F.slice("es", F.lit(1), F.greatest(F.lit(0), kept).cast("int")).alias("es"))
    return first.select("c1", F.explode_outer("es").alias("e")).filter("e IS NOT NULL").select(F.col("e.gram").alias("gram"), "c1")


def possible_sets(sets: DataFrame) -> DataFrame:
    """c1: the digests of all sets of a set_table that may be linked with another, found by their prefixes alone.

    Two prefixes with k or more common elements share one of the `most` - k + 1 rarest elements of each. As what is
    common in the corpus comes last, boilerplate makes few sets possible. Elements that one row holds stand first and
    meet nobody: only their number counts.
    """
    elements = sets.filter("doc_id IS NOT NULL AND most > 0").select(F.explode("grams").alias("gram"), "c1", "most", "k")
    held = durable(elements.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "jaccard-held")
    kept = durable(rarest(elements, held, F.size("es") - F.col("k") + 1), "jaccard-rare")
    met = durable(kept.groupBy("gram").agg(F.min("c1").alias("a"), F.max("c1").alias("b")).filter("a < b").select("gram"), "jaccard-met")
    return durable(kept.join(met, "gram").select("c1").distinct(), "jaccard-possible")


class PrefixTree:
    """A compressed trie over sets written in one order; each path counts its overlap with a query once for all below."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        # A node: children by first element, sets that end here, and of the sets below least and largest size and the
        # least number of elements that no other set has.
        self.root: list = [{}, [], 1 << 62, 0, 1 << 62]

    def add(self, ranks: np.ndarray, size: int, name: int) -> None:
        node, at, own = self.root, 0, size - len(ranks)
        node[2], node[3], node[4] = min(node[2], size), max(node[3], size), min(node[4], own)
        while at < len(ranks):
            edge = node[0].get(int(ranks[at]))
            if edge is None:
                leaf = [{}, [(name, size)], size, size, own]
                node[0][int(ranks[at])] = [ranks[at:], leaf]
                return
            label, child = edge
            n = min(len(label), len(ranks) - at)
            differ = np.flatnonzero(label[:n] != ranks[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(label):  # split the edge
                middle = [{int(label[same]): [label[same:], child]}, [], child[2], child[3], child[4]]
                node[0][int(ranks[at])] = [label[:same], middle]
                child = middle
            child[2], child[3], child[4] = min(child[2], size), max(child[3], size), min(child[4], own)
            node, at = child, at + same
        node[1].append((name, size))

    def linked(self, inside: np.ndarray, up_to: np.ndarray, size: int) -> Iterator[int]:
        """Names of the stored sets linked with a query: `inside` marks its elements, `up_to` counts them by rank."""
        p, own = self.percent, size - int(up_to[-1])
        stack = [(self.root, 0, 0, 0)]  # node, overlap, elements on the path, the query's elements up to here
        while stack:
            node, overlap, depth, passed = stack.pop()
            for name, n in node[1]:
                if 100 * overlap >= p * (size + n - overlap):
                    yield name
            for label, child in node[0].values():
                o, d, q = overlap + int(inside[label].sum()), depth + len(label), int(up_to[label[-1]])
                # What differs up to here, and what no other set has, bounds what can be equal in the remaining lengths.
                if (100 + p) * ((d - o) + (q - o) + own + child[4]) <= (100 - p) * (size + child[3]) and p * child[2] <= 100 * size and p * size <= 100 * child[3]:
                    stack.append((child, o, d, q))


def _find(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def join_block(ids: np.ndarray, left: np.ndarray, sets: list[np.ndarray], percent: int, crossing: bool) -> list[tuple[int, int]]:
    """Links that join the documents of a block (or of two blocks, across) into components; others are implied.

    Sets stand in the global order, that of their hashes; elements found in one set only are counted, not stored.
    """
    every, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = int((count > 1).sum())
    rank = np.where(count > 1, np.cumsum(count > 1) - 1, shared)
    ends = np.cumsum([len(s) for s in sets])
    ranked = [r[r < shared] for r in np.split(rank[inverse], ends[:-1])]
    parent = {i: i for i in range(len(ids))}
    tree, links = PrefixTree(percent), []
    inside = np.zeros(shared + 1, np.int64)
    order = np.argsort([len(s) for s in sets], kind="stable")
    stored = order[left[order]] if crossing else ()
    for i in stored:
        tree.add(ranked[i], len(sets[i]), int(i))
    for i in order:
        if crossing and left[i]:
            continue
        inside[ranked[i]] = 1
        for j in tree.linked(inside, np.cumsum(inside), len(sets[i])):
            a, b = _find(parent, int(i)), _find(parent, j)
            if a != b:
                parent[a] = b
                links.append((int(ids[i]), int(ids[j])))
        inside[ranked[i]] = 0
        if not crossing:
            tree.add(ranked[i], len(sets[i]), int(i))
    return links


def set_elements(docs: DataFrame, width: int) -> DataFrame:
    """(gram, c1, n): a row for each element of each set, with the set's digest and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, counts = _lists(batch, width)
            rows = np.repeat(np.arange(len(counts)), counts)
            whole = _digest(grams, rows, len(counts), _SEEDS[0])
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(whole[rows]), pa.array(counts[rows])], ["gram", "c1", "n"])

    return _hashed(docs).mapInArrow(run, "gram long, c1 long, n long")


def with_digests(docs: DataFrame, width: int) -> DataFrame:
    """Adds to documents (doc_id, text) their sets' digest c1 and size n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            grams, counts = _lists(batch, width)
            whole = _digest(grams, np.repeat(np.arange(len(counts)), counts), len(counts), _SEEDS[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(whole), pa.array(counts)], ["doc_id", "text", "c1", "n"])

    return _hashed(docs, "text").mapInArrow(run, "doc_id long, text string, c1 long, n long")


def candidate_groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(c1, component, blocks): groups of the sets (doc_id, text, c1, n) that no link leaves.

    Linked sets share one of their first n - least_common(n) + 1 elements in any one order; here, the rare ones of these
    documents come first. A set is joined with the least one that it shares such an element with. A group's number of
    blocks bounds what a task holds.
    """
    elements = set_elements(docs, width)
    held = durable(elements.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1"), "jaccard-common")
    kept = durable(rarest(elements, held, F.size("es") - F.expr(f"({percent} * n + 99) div 100") + 1), "jaccard-rarest")
    centres = durable(kept.groupBy("gram").agg(F.min("c1").alias("a"), F.max("c1").alias("z")).filter("a < z").select("gram", "a"), "jaccard-centres")
    edges = kept.join(centres, "gram").filter("a <> c1").select("a", F.col("c1").alias("b")).distinct()
    groups = connected_components(edges).withColumnRenamed("node", "c1")
    sizes = docs.select("c1", "n").join(groups, "c1").groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("elements"))
    blocks = F.greatest(F.ceil(F.col("docs") / _BLOCK_DOCS), F.ceil(F.col("elements") / _BLOCK_ELEMENTS)).cast("int")
    return groups.join(durable(sizes.select("component", blocks.alias("blocks")), "jaccard-blocks"), "component")


def linked_pairs(candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) inside candidate groups (doc_id, text, component, blocks)."""
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    meet = (
        candidates.withColumn("mine", mine)
        .select("doc_id", "component", "mine", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("doc_id", "component", "text", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("is_left"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in pieces(batches):
            grams, counts = _lists(batch, width)
            sets = np.split(grams, np.cumsum(counts)[:-1]) if len(counts) else []
            keys = zip(batch.column("component").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True)
            for k, doc, is_left, s in zip(keys, batch.column("doc_id").to_pylist(), batch.column("is_left").to_pylist(), sets, strict=True):
                if k != key:
                    yield from finish(key, held)
                    key, held = k, []
                if len(s):
                    held.append((doc, is_left, s))
        yield from finish(key, held)

    def finish(key, held) -> Iterator[pa.RecordBatch]:
        if len(held) < 2:
            return
        ids, left, sets = (list(x) for x in zip(*held, strict=True))
        links = join_block(np.array(ids), np.array(left, bool), sets, percent, key[1] != key[2])
        if links:
            a, b = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = meet.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "doc_id")
    return _hashed(dealt, "component", "i", "j", "is_left").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """Joins documents whose shingle sets have a Jaccard of at least `percent` into components.

    A set holds the distinct runs of `width` words (A-Z lower-cased); of fewer words, the whole sequence; none of no
    words. Returns doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included). Equal
    sets are one class with one representative. Prefixes of the sets in a global order show which may be linked at all;
    the full sets of these, rare elements first, give candidate groups, which no link leaves. In each group prefix
    trees find the links; a group larger than a block is split into blocks that meet in pairs. No candidate is dropped.

    Documents without words are linked with nothing. A null id has a null component. Several rows of one id are one
    document with several sets. Long texts are sets like others, of as many elements as they have; batches are cut so
    that a task holds about a million words or one text. An empty table gives an empty result; further columns are
    ignored. Which of two equal sets is looked at makes no difference (ties).
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = durable(set_table(base, width, percent), "jaccard-sets")
    digests = sets.select("doc_id", "n_shingles", "c1", "c2")
    classes = durable(digests.filter("doc_id IS NOT NULL AND n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "jaccard-classes")
    # Digests name sets; were two sets to share one, both would be candidates, and nothing would be lost.
    possible = possible_sets(sets)
    reps = durable(classes.join(possible, "c1").select(F.col("rep").alias("doc_id")).distinct(), "jaccard-reps")
    texts = durable(with_digests(base.join(reps, "doc_id", "left_semi"), width), "jaccard-candidates")
    groups = durable(candidate_groups(texts, width, percent), "jaccard-groups")
    links = durable(linked_pairs(texts.join(groups, "c1"), width, percent), "jaccard-links")
    found = connected_components(links).withColumnRenamed("node", "rep")
    labelled = durable(classes.join(found, "rep", "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id")), "jaccard-labels")
    # Without words there is no class; the document is its own component.
    return digests.join(labelled, ["c1", "c2"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).alias("component_id")
    )


def drop_near_copies(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """One document of each component stays, that with the least id; rows without an id stay."""
    components = jaccard_components(docs, width, percent)
    gone = durable(components.filter("doc_id IS NOT NULL AND doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
