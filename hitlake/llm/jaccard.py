"""Exact Jaccard similarity join of documents over word shingles, in a metric space with pivots.

The Jaccard distance d is a metric, and documents link at d <= eps. A pivot that shares nothing with a document says
nothing of it (d is 1), so documents that cannot link are kept apart first, and pivots rule where distances differ:

* shingles are ordered, rare ones first, by corpus counts in a table whose size follows the number of rows up to a
  bound; two documents that link share one among the first ``n - ceil(t n) + 1`` of each (any order gives right
  results). The documents with one such shingle, of sizes that allow a link, form a neighbourhood, named by one of
  them; equal names are one neighbourhood. So every pair that links meets in one;
* the others of a neighbourhood allow a link only if the bound of its folded shingle counts does (folding shingles into
  buckets never lengthens a distance); documents without such a partner go no further;
* a neighbourhood of more than ``CELL`` documents is cut into Voronoi regions: up to ``PIVOTS`` of its members become
  pivots, each document belongs to the region of the nearest one, and by the triangle inequality it is replicated to
  every region whose pivot is farther by no more than 2 eps, so that a pair that links still meets in a region.
  Documents farther than 1 - 2 eps from every pivot would be in all regions; they make a region of their own, with all
  documents that are within eps of that bound. The documents that link to the pivot with the most links are settled:
  they are in one class, so they go on only where their distance is within eps of one that is not settled. Regions
  that are still large are cut again with new pivots;
* a region that pivots do not cut (its documents are about equally far from all of them) is joined block by block,
  by classes of set size, of which only neighbours meet, and settled ones not with each other;
* what fits is joined by products of 0/1 matrices, and each region returns a spanning forest of its links.

Classes are the connected components of the links (alternating minimum stars). Documents of equal text are one node;
their 64-bit text hashes are taken as distinct. Only hashes are shuffled, and whole shingle sets only for documents
that stand in a neighbourhood.

A document with fewer words than ``k`` has its whole sequence as one shingle; null and empty texts have none and
link with nothing. Rows with null doc_id get n_shingles and a null component, and link with nothing. Rows that repeat
a doc_id are one document if their texts are equal; if not, the id joins the classes of all its texts. An empty table
gives no rows; columns other than doc_id and text are ignored. A long text is shingled whole, by one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut_lineage, remove, shared_folder
from .text import Seen, gram_hashes, mixed, slices, tidy, utf8, whole, word_ids

COUNTERS = (16, 22)  # least and most bits of the table of counts
BLOB = 1 << 14  # counters in one row
HOT = 4096  # rows of a shingle that one task may get
CELL = 128  # documents of a neighbourhood that pivots do not cut; those of many shingles count more
BLOCK = 128  # documents joined by one product where pivots cannot cut
WEIGHT = 4096  # shingles that count as one more document
PIVOTS = 32
PART = 1024  # documents measured together
LEVELS = 16
SMALL = 1 << 18  # places of texts in neighbourhoods that may be broadcast


@dataclass(frozen=True)
class Rule:
    """Shingles of k words link two sets when 100 * intersection >= percent * union."""

    k: int = 5
    percent: int = 80

    @property
    def eps(self) -> float:
        return 1 - self.percent / 100

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many of the rarest of n shingles must hold one of a linked set."""
        return n - -(-self.percent * n // 100) + 1

    def links(self, both: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """both: intersections; sizes: sums of the two set sizes."""
        return (100 * both >= self.percent * (sizes - both)) & (both > 0)

    def size_class(self, n: Column) -> Column:
        """Sets that link are of one class or of classes next to each other."""
        return F.floor(F.log(n.cast("double")) / float(-np.log(self.percent / 100)) + 1e-9).cast("int")


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    ids, offsets = word_ids(texts, lower=True)
    grams, sets = gram_hashes(ids, k), []
    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if z - a >= k:
            own = np.sort(grams[a : z - k + 1])
            sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif z > a:
            sets.append(mixed(gram_hashes(ids[a:z], z - a) ^ np.uint64(z - a)))
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def folded(shingles: np.ndarray) -> np.ndarray:
    """Counts of shingles by bucket (a power of two of them, about half as many as shingles)."""
    size = 1 << min(11, max(4, int(len(shingles) // 2).bit_length()))
    return np.bincount((shingles >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)


def _possible(n: np.ndarray, folds: list[np.ndarray], rule: Rule) -> np.ndarray:
    """Which of some texts may link to another by their folded counts."""
    size = min(map(len, folds))
    table = np.stack([f.reshape(size, -1).sum(1) for f in folds])
    stays = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        both = np.minimum(table[i], table[i + 1 :]).sum(1)
        near = (100 * both >= rule.percent * (n[i] + n[i + 1 :] - both)) & (100 * np.minimum(n[i], n[i + 1 :]) >= rule.percent * np.maximum(n[i], n[i + 1 :]))
        stays[i] |= near.any()
        stays[i + 1 :] |= near
    return stays


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("c"), utf8().alias("text"))


def _sliced(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Keys and shingle sets of the texts of a task, slice by slice; most texts that a task sees again are passed over."""
    seen = Seen()
    for b in batches:
        rows = [(c, t) for c, t in zip(b.column("c").to_pylist(), b.column("text").to_pylist(), strict=True) if t and seen.new(c)]
        for lo, hi in slices([t for _, t in rows]):
            yield [c for c, _ in rows[lo:hi]], shingle_sets([t for _, t in rows[lo:hi]], k)


def survey(keyed: DataFrame, rule: Rule, bits: int) -> DataFrame:
    """Of each text: c and n (place null); of each task: its counts by hashed shingle, BLOB at a time (c null)."""
    size = 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(size, np.int64), []

        def add() -> None:
            nonlocal counts
            counts += np.bincount((np.concatenate([*held, np.empty(0, np.uint64)]) & np.uint64(size - 1)).astype(np.int64), minlength=size)
            held.clear()

        for keys, sets in _sliced(batches, rule.k):
            held += sets
            if sum(map(len, held)) > size // 2:
                add()
            yield pa.RecordBatch.from_pydict({"c": pa.array(keys, pa.int64()), "n": pa.array(map(len, sets), pa.int32()), "place": pa.nulls(len(keys), pa.int32()), "counts": pa.nulls(len(keys), pa.binary())})
        add()
        for lo in range(0, size, BLOB):
            some = counts[lo : lo + BLOB]
            if some.any():
                yield pa.RecordBatch.from_pydict({"c": pa.nulls(1, pa.int64()), "n": pa.nulls(1, pa.int32()), "place": pa.array([lo // BLOB], pa.int32()), "counts": pa.array([some.astype("u1" if some.max() < 256 else "<u4").tobytes()], pa.binary())})

    return keyed.select("c", "text").mapInArrow(tidy(run), "c long, n int, place int, counts binary")


def _counts(seen: DataFrame, bits: int) -> np.ndarray:
    """The table of counts of all tasks, 2^bits numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # no more places than the table has
        for b in batches:
            for place, counts in zip(b.column("place").to_pylist(), b.column("counts").to_pylist(), strict=True):
                held[place] = held.get(place, 0) + np.frombuffer(counts, "u1" if len(counts) == BLOB else "<u4").astype(np.int64)
        for place, counts in held.items():
            yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "counts": pa.array([np.minimum(counts, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    table = np.zeros(1 << bits, np.uint32)
    for r in seen.where("place IS NOT NULL").select("place", "counts").repartition("place").mapInArrow(tidy(run), "place int, counts binary").toLocalIterator():
        table[r["place"] * BLOB : r["place"] * BLOB + BLOB] = np.frombuffer(r["counts"], "<u4")
    return table


def prefixes(keyed: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(h, c, n, hot): the rare shingles of each text by which it can be found; hot: more than HOT texts may have it."""
    shared, most = keyed.sparkSession.sparkContext.broadcast(counts), HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for keys, sets in _sliced(batches, rule.k):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            flat, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            often = table[(flat & np.uint64(len(table) - 1)).astype(np.int64)]
            # within a text by count, then by hash: the sets are sorted, and the sort is stable
            order = np.argsort(doc.astype(np.uint64) << np.uint64(32) | often, kind="stable")
            at = order[np.arange(len(flat)) - (np.cumsum(n) - n)[doc] < rule.prefix(n)[doc]]
            who = doc[at]
            yield pa.RecordBatch.from_pydict({"h": pa.array(flat[at].view(np.int64)), "c": pa.array(np.array(keys, np.int64)[who]), "n": pa.array(n[who].astype(np.int32)), "hot": pa.array(often[at] > most)})

    return keyed.select("c", "text").mapInArrow(tidy(run), "h long, c long, n int, hot boolean")


def _by_runs(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more (but for the last) of rows sorted by key, no key in two of them."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def neighbourhoods(found: DataFrame, rule: Rule) -> DataFrame:
    """(p, c): members of the neighbourhoods, p too, of texts of one shingle whose sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "h", 1 << 15):
            h, n, c = (t.column(x).to_numpy() for x in ("h", "n", "c"))
            same = np.concatenate([[False], h[1:] == h[:-1]])
            again = same & np.concatenate([[False], c[1:] == c[:-1]])  # a text that several tasks have seen
            h, n, c, same = h[~again], n[~again].astype(np.int64), c[~again], same[~again]
            near = same & np.concatenate([[False], 100 * n[:-1] >= rule.percent * n[1:]])
            stays = near | np.append(near[1:], False)
            h, c = h[stays], c[stays]
            first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
            p = np.minimum.reduceat(c, np.flatnonzero(first))[np.cumsum(first) - 1] if len(h) else c
            pairs = np.unique(np.stack([p, c], 1), axis=0)
            yield pa.RecordBatch.from_pydict({"p": pa.array(pairs[:, 0]), "c": pa.array(pairs[:, 1])})

    # at most HOT texts, and their repeats in other tasks, stand behind one h
    few = found.where("NOT hot").select("h", "n", "c").repartition("h").sortWithinPartitions("h", "n", "c").mapInArrow(run, "p long, c long")
    hot = found.where("hot").select("h", "c")
    most = hot.groupBy("h").agg(F.min("c").alias("p"), F.max("c").alias("q")).where("p < q").select("h", "p")
    return few.unionByName(hot.join(most, "h").select("p", "c")).distinct()


def _forest(members: list, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (places in members), as links from members to their root."""
    up = list(range(len(members)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs:
        up[max(root(i), root(j))] = min(root(i), root(j))
    return [(members[i], members[root(i)]) for i in range(len(members)) if root(i) != i]


def _shared_counts(own: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of two lists of sets, by a product of 0/1 matrices over the shingles that both lists hold."""
    words, place = np.unique(np.concatenate([*own, *others]), return_inverse=True)
    cut = np.cumsum([len(x) for x in own + others])[:-1]
    parts = np.split(place, cut)
    once = np.bincount(place, minlength=len(words)) > 1
    column = np.cumsum(once) - 1
    out = np.zeros((len(own), len(others)), np.int64)
    width = int(once.sum())
    for lo in range(0, width, 8192):  # a bounded strip of shingles at a time
        hi = min(width, lo + 8192)
        a, b = np.zeros((len(own), hi - lo), np.float32), np.zeros((len(others), hi - lo), np.float32)
        for k, part in enumerate(parts):
            at = column[part[once[part]]]
            at = at[(at >= lo) & (at < hi)] - lo
            if k < len(own):
                a[k, at] = 1
            else:
                b[k - len(own), at] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    return out


def _chosen(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """c, text and the other columns of wanted (c, d, times): one row for each, though rows may repeat a document."""
    size = F.sum(F.size("ps")) if "ps" in wanted.columns else F.count("*")
    few = (wanted.agg(size).first()[0] or 0) <= SMALL
    rows = keyed.join(F.broadcast(wanted) if few else wanted.hint("merge"), ["c", "d"])
    names = ["c", "text", *(x for x in wanted.columns if x not in ("c", "d", "times"))]
    if not wanted.where("times > 1").limit(1).count():
        return rows.select(*names)
    return rows.where("times = 1").select(*names).unionByName(rows.where("times > 1").dropDuplicates(["c"]).select(*names))


def _sets_of(keyed: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """(c, n, shingles) of the texts in wanted (c, d, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in _sliced(batches, rule.k):
            yield pa.RecordBatch.from_pydict({"c": pa.array(keys, pa.int64()), "n": pa.array(map(len, sets), pa.int32()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    return _chosen(keyed, wanted).select("c", "text").mapInArrow(tidy(run), "c long, n int, shingles binary")


def _placed(keyed: DataFrame, members: DataFrame, firsts: DataFrame, rule: Rule, fold: bool) -> DataFrame:
    """(p, c, n, data): members (p, c) of small regions with their folded counts or whole sets."""
    wanted = members.groupBy("c").agg(F.collect_list("p").alias("ps")).join(firsts, "c")  # no more than a text's shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(c, t, ps) for c, t, ps in zip(*(b.column(x).to_pylist() for x in ("c", "text", "ps")), strict=True)]
            for lo, hi in slices([t for _, t, _ in rows]):
                out: list[tuple] = []
                for (c, _, ps), own in zip(rows[lo:hi], shingle_sets([t for _, t, _ in rows[lo:hi]], rule.k), strict=True):
                    data = folded(own).astype("<u4").tobytes() if fold else own.tobytes()
                    out += [(p, c, len(own), data) for p in ps]
                for k in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out[k : k + 1000], strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["p", "c", "n", "data"])

    return _chosen(keyed, wanted).mapInArrow(tidy(run), "p long, c long, n int, data binary")


def possible(members: DataFrame, rule: Rule) -> DataFrame:
    """Of members (p, c, n, data: folded counts) of small regions those (p, c) that may link to another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "p", 4 * BLOCK):
            p, n = t.column("p").to_numpy(), t.column("n").to_numpy().astype(np.int64)
            folds = [np.frombuffer(x, "<u4").astype(np.int64) for x in t.column("data").to_pylist()]
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            stays = np.concatenate([_possible(n[a:z], folds[a:z], rule) for a, z in zip(cuts, cuts[1:], strict=False)])
            yield from t.select(["p", "c"]).filter(pa.array(stays)).combine_chunks().to_batches()

    return members.repartition("p").sortWithinPartitions("p").mapInArrow(tidy(run), "p long, c long")


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


LINKS = "a long, b long"


def _edges(pairs: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})


def _linked(keys: list[int], sets: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """A spanning forest of the links among some texts."""
    n = np.array([len(s) for s in sets])
    at = np.argwhere(np.triu(rule.links(_shared_counts(sets, sets), n[:, None] + n[None, :]), 1))
    return _forest(keys, map(tuple, at.tolist()))


def _within(members: DataFrame, rule: Rule) -> DataFrame:
    """Links among the members (p, c, data: sets) of regions that fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_runs(batches, "p", 4 * BLOCK):
            p, keys, sets = t.column("p").to_numpy(), t.column("c").to_pylist(), _sets(t.column("data"))
            cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)]
            pairs = [x for a, z in zip(cuts, cuts[1:], strict=False) for x in _linked(keys[a:z], sets[a:z], rule)]
            yield from _edges(pairs).to_batches()

    return members.select("p", "c", "data").repartition("p").sortWithinPartitions("p").mapInArrow(tidy(run), LINKS)


def _weight(n: str = "n") -> Column:
    return 1 + F.floor(F.col(n) / WEIGHT)


def _measured(members: DataFrame, crowds: DataFrame, sets: DataFrame, rule: Rule, level: int) -> DataFrame:
    """(p, crowd, c, n, pivots, away, links): distances of the members of large regions from the pivots, and a bit for each that links."""
    order = F.xxhash64("c", F.lit(level))
    picked = members.join(crowds, "p").groupBy("p", "crowd", F.pmod(order, F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(order.alias("o"), "c"))["c"].alias("c"))
    parts = F.ceil(F.col("crowd") / PART).cast("int")
    pivots = picked.join(sets, "c").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(F.col("p").alias("of"), F.col("part").alias("of_part"), F.col("c").alias("pivot"), F.col("shingles").alias("points"))
    own = members.join(crowds, "p").join(sets, "c").select("p", F.pmod(F.xxhash64("c"), parts.cast("long")).cast("int").alias("part"), "crowd", "c", "n", "shingles")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pivot")
        a, b = _sets(left.column("shingles")), _sets(right.column("points"))
        sizes = np.array([len(s) for s in a], np.int64).reshape(-1, 1) + np.array([len(s) for s in b], np.int64).reshape(1, -1)
        both = _shared_counts(a, b) if a and b else np.zeros(sizes.shape, np.int64)
        away = 1 - both / np.maximum(sizes - both, 1)
        links = (rule.links(both, sizes).astype(np.int64) << np.arange(len(b))).sum(1)
        names = pa.array([right.column("pivot").to_pylist()] * len(a), pa.list_(pa.int64()))
        return pa.table({"p": left.column("p"), "crowd": left.column("crowd"), "c": left.column("c"), "n": left.column("n"), "pivots": names, "away": pa.array(away.tolist(), pa.list_(pa.float64())), "links": pa.array(links, pa.int64())})

    return own.groupBy("p", "part").cogroup(pivots.groupBy("of", "of_part")).applyInArrow(run, "p long, crowd long, c long, n int, pivots array<long>, away array<double>, links long")


def _bit(links: Column, k: Column) -> Column:
    return F.shiftright(links, k).bitwiseAND(F.lit(1).cast("long")) == 1


def _regions(measured: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of measured members with ``settled`` and their places (-1: far from all pivots): links, all members, and (p, crowd, place, c, n) of those that go on."""
    eps = rule.eps + 1e-9
    votes = measured.groupBy("p").agg(F.array(*(F.sum(F.shiftright("links", k).bitwiseAND(F.lit(1).cast("long"))) for k in range(PIVOTS))).alias("votes"))
    hubs = votes.select("p", (F.array_position("votes", F.array_max("votes")) - 1).cast("int").alias("hub"))
    own = F.array_min("away")
    at = lambda j: F.when(j < 0, own).otherwise(F.try_element_at("away", F.greatest(j, F.lit(0)) + 1))
    near = F.filter(F.sequence(F.lit(0), F.size("away") - 1), lambda j: (own <= 1 - 2 * eps) & (at(j) <= own + 2 * eps))
    places = F.concat(near, F.when(own > 1 - 3 * eps, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    rows = measured.join(hubs, "p").withColumns({"settled": F.expr("(shiftright(links, hub) & 1) = 1"), "places": places})
    linked = F.filter(F.sequence(F.lit(0), F.size("pivots") - 1), lambda j: F.expr("links").isNotNull() & F.when(F.col("settled"), j == F.col("hub")).otherwise(F.lit(True)))
    pairs = rows.where("links <> 0").select("c", "links", "pivots", F.explode(linked).alias("j")).where(F.expr("(shiftright(links, j) & 1) = 1"))
    links = pairs.select(F.col("c").alias("a"), F.element_at("pivots", F.col("j") + 1).alias("b")).where("a <> b")

    few = rows.groupBy("p", "crowd").agg(F.sum(F.when(~F.col("settled"), F.size("places") * _weight()).otherwise(0)).alias("copies")).where("copies > 0 AND copies <= 2 * crowd").select("p")
    open_rows = rows.join(few, "p", "left_semi")
    loose = open_rows.where("NOT settled").select("p", "crowd", "c", "n", F.explode("places").alias("place"), "away").select("p", "crowd", "c", "n", "place", at(F.col("place")).alias("d"))
    span = loose.groupBy("p", "place").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    spans = span.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct("lo", "hi")))).alias("spans"))  # PIVOTS + 1 at most
    within = F.filter("places", lambda j: F.coalesce(at(j).between(F.try_element_at("spans", j)["lo"] - eps, F.try_element_at("spans", j)["hi"] + eps), F.lit(False)))
    tied = open_rows.where("settled").join(spans, "p").select("p", "crowd", "c", "n", F.explode(within).alias("place"))
    return links, rows, loose.drop("d").unionByName(tied)


def _blocks(members: DataFrame, rule: Rule) -> DataFrame:
    """Links among the members (p, c, n, settled, shingles) of regions that pivots do not cut: blocks of about BLOCK meet, if not both are settled."""
    rows = members.withColumn("size", 2 * rule.size_class(F.col("n")) + F.col("settled").cast("int"))
    parts = rows.groupBy("p", "size").agg(F.ceil(F.sum(_weight()) / BLOCK).cast("int").alias("parts"))
    placed = rows.join(parts, ["p", "size"]).withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts").cast("long")).cast("int"))
    every = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("p", "size", "part")
    x, y = every.alias("x"), every.alias("y")
    class_of = lambda t: F.floor(F.col(f"{t}.size") / 2)
    after = (F.col("y.size") > F.col("x.size")) | ((F.col("y.size") == F.col("x.size")) & (F.col("y.part") >= F.col("x.part")))
    open_pair = (F.col("x.size") % 2 == 0) | (F.col("y.size") % 2 == 0)
    meets = x.join(y, (F.col("x.p") == F.col("y.p")) & after & (class_of("y") - class_of("x") <= 1) & open_pair)
    meet = F.xxhash64("x.size", "x.part", "y.size", "y.part").alias("meet")
    sides = meets.select("x.p", "x.size", "x.part", meet, F.lit(0).alias("side")).unionByName(meets.where("x.size <> y.size OR x.part <> y.part").select("y.p", "y.size", "y.part", meet, F.lit(1).alias("side")))
    sent = placed.join(sides, ["p", "size", "part"]).select("p", "meet", "side", "c", "shingles")

    def run(t: pa.Table) -> pa.Table:
        side = np.array(t.column("side").to_pylist())
        keys, sets = t.column("c").to_pylist(), _sets(t.column("shingles"))
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(two):
            return _edges(_linked(keys, sets, rule))
        n = np.array([len(s) for s in sets])
        at = np.argwhere(rule.links(_shared_counts([sets[i] for i in one], [sets[i] for i in two]), n[one][:, None] + n[two][None, :]))
        return _edges(_forest(keys, ((int(one[i]), int(two[j])) for i, j in at)))

    return sent.groupBy("p", "meet").applyInArrow(run, LINKS)


def _stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def join_regions(members: DataFrame, sets: DataFrame, rule: Rule, folder: str) -> DataFrame:
    """Links (a, b) of the members (p, c) of all regions: Voronoi regions of large ones, again and again, then products."""
    sizes, found = sets.select("c", "n"), []
    settled, fits = F.lit(False).alias("settled"), f"crowd <= {CELL} OR members = 2"
    for level in range(LEVELS + 1):
        crowds = _stored(members.join(sizes, "c").groupBy("p").agg(F.sum(_weight()).alias("crowd"), F.count("*").alias("members")).where("members > 1"), folder, f"crowds-{level}")
        small = members.join(crowds.where(fits).select("p"), "p", "left_semi")
        found.append(_stored(_within(small.join(sets, "c").withColumnRenamed("shingles", "data"), rule), folder, f"within-{level}"))
        large = crowds.where(f"NOT ({fits})").select("p", "crowd")
        if not large.limit(1).count():
            break
        if level == LEVELS:
            found.append(_stored(_blocks(members.join(large.select("p"), "p", "left_semi").join(sets, "c").select("*", settled), rule), folder, "rest"))
            break
        links, rows, going = _regions(_stored(_measured(members, large, sets, rule, level), folder, f"measured-{level}"), rule)
        found.append(_stored(links, folder, f"pivots-{level}"))
        going = _stored(going, folder, f"going-{level}")
        # pivots cut a region if its parts are well smaller and not more than twice as many documents together
        parts = going.groupBy("p", "crowd", "place").agg(F.sum(_weight()).alias("part"))
        cut = _stored(parts.groupBy("p", "crowd").agg(F.max("part").alias("most"), F.sum("part").alias("all")).where("most <= 0.8 * crowd AND all <= 2 * crowd").select("p"), folder, f"cut-{level}")
        rest = rows.join(rows.where("NOT settled").select("p").distinct(), "p", "left_semi").join(cut, "p", "left_anti").select("p", "c", "settled")
        found.append(_stored(_blocks(rest.join(sets, "c"), rule), folder, f"blocks-{level}"))
        members = _stored(going.join(cut, "p", "left_semi").select(F.xxhash64("p", "place", F.lit(level)).alias("p"), "c"), folder, f"regions-{level}")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node it reaches. Alternating large and small stars."""
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(joined.select("u", F.col("m").alias("v"))).distinct()
        after = cut_lineage(small)
        if not after.exceptAll(edges).limit(1).count() and not edges.exceptAll(after).limit(1).count():
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = after


def links(docs: DataFrame, rule: Rule, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents (d, c, n) of all rows, and links (a, b) between texts by their first documents' ids; folder holds what lies between."""
    keyed = _keyed(docs)
    bits = int(np.clip(keyed.count() * 4, 1, 1 << COUNTERS[1])).bit_length()
    bits = int(np.clip(bits, *COUNTERS))
    seen = _stored(survey(keyed, rule, bits), folder, "survey")
    sizes = seen.where("c IS NOT NULL").select("c", "n").dropDuplicates(["c"])
    once = keyed.where("d IS NOT NULL").groupBy("c", "d").agg(F.count("*").alias("times"))
    firsts = once.groupBy("c").agg(F.min(F.struct("d", "times")).alias("f")).select("c", "f.d", "f.times")

    members = neighbourhoods(prefixes(keyed, _counts(seen, bits), rule), rule)
    members = _stored(members.join(sizes, "c").join(firsts.select("c"), "c", "left_semi").select("p", "c", "n"), folder, "members")
    crowds = _stored(members.groupBy("p").agg(F.sum(_weight()).alias("crowd"), F.count("*").alias("members")), folder, "crowds")
    fits = f"crowd <= {CELL} OR members = 2"
    small = members.join(crowds.where(f"members > 1 AND ({fits})"), "p", "left_semi").select("p", "c")
    staying = _stored(possible(_placed(keyed, small, firsts, rule, fold=True), rule), folder, "staying")
    near = _within(_placed(keyed, staying, firsts, rule, fold=False), rule)
    large = _stored(members.join(crowds.where(f"NOT ({fits})"), "p", "left_semi").select("p", "c"), folder, "large")
    sets = _stored(_sets_of(keyed, large.select("c").distinct().join(firsts, "c"), rule), folder, "sets")
    texts = _stored(near.unionByName(join_regions(large, sets, rule, f"{folder}/regions")).distinct(), folder, "links")

    of = lambda k: firsts.select(F.col("c").alias(k), F.col("d").alias(f"{k}_d"))
    between_docs = texts.join(of("a"), "a").join(of("b"), "b").select(F.col("a_d").alias("a"), F.col("b_d").alias("b"))
    rows = keyed.select("d", "c").join(sizes, "c", "left").select("d", "c", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    copies = rows.where("d IS NOT NULL AND n > 0").join(firsts.select("c", F.col("d").alias("first")), "c").where("d <> first").select(F.col("d").alias("a"), F.col("first").alias("b"))
    return rows, between_docs.unionByName(copies)


def classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    folder = shared_folder(docs.sparkSession, "jaccard")
    rows, found = links(docs, rule, folder)
    parts = components(found)  # checkpointed: of what lies between only the sizes are still read
    remove(docs.sparkSession, *(f"{folder}/{x}" for x in ("members", "crowds", "staying", "large", "sets", "links", "regions")))
    joined = rows.join(parts, rows["d"] == parts["node"], "left")
    return joined.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "d").alias("component_id"))
