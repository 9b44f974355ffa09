"""Near-duplicate components by bottom-k sketches of one hash function.

Each text is the set of its word shingles' hashes. Equal sets are one class. A class's sketch is
its k smallest hashes; the first few of them name the inverted lists that it is on. Short lists give every pair whose retained values overlap enough; long ones give the pairs
with some leaders and neighbours. Once these are resolved, texts on long lists that still join
different components meet on lists of three values, where every pair across components is looked
at that sizes and shingles of their own (in no other of these texts) let reach the threshold.
Candidates are filtered by the similarity that their union's sketch estimates, and links are
confirmed on full sets: each text's likeliest partners first, then pairs that are still across
components, so that a large group of copies costs a few comparisons for each copy. The chance that
two texts at the threshold itself don't meet or fail the estimate is about one in a hundred thousand,
and far less above it. Vectors of values are joined by shuffles at every size. A list of three values is read by one task.

Defined cases: a text that is null or has no word has an empty set and is linked with nothing; a
text with fewer words than a shingle has one shingle, the whole; rows that repeat a doc_id are
nodes each; a null doc_id takes part, and isn't a component's id unless all of it are null;
an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binaries, blocks, bucketed, join_unique, mix, ragged, release, stage, strings, table, tidy, words, workers
from .components import components

SKETCH, LISTED, SHORT, LEADERS, NEIGHBOURS, OVERLAP, CROWD = 128, 12, 32, 1, 1, 3, 128
#: A list of more than twice SHARE is read in random shares of about SHARE texts, so that no text meets more than so many on it.
SHARE = 500
BROADCAST_IDS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n_words: int) -> list[np.ndarray]:
    """For each text its shingles' hashes, sorted and distinct."""
    out: list[np.ndarray] = []
    for i, j in blocks(offsets):
        hashes, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        rolled = np.zeros(max(0, len(hashes) - n_words + 1), np.uint64)
        for w in range(n_words):
            rolled = mix(rolled * _ODD + hashes[w : w + len(rolled)])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= n_words:
                out.append(np.unique(rolled[a : b - n_words + 1]))
            elif b > a:
                short = np.zeros(1, np.uint64)
                for h in hashes[a:b]:
                    short = mix(short * _ODD + h)
                out.append(short ^ np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    one, two = mix(s).sum(dtype=np.uint64), mix(s ^ _ODD).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sketch(n_words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(*strings(batch["text"]), n_words)
            digests = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            columns = {"row": batch["row"], "doc_id": batch["doc_id"]}
            columns |= {"n": pa.array([len(s) for s in sets], pa.int64()), "h1": pa.array(digests[:, 0].copy()), "h2": pa.array(digests[:, 1].copy())}
            columns["low"] = pa.array([x[:LISTED].tobytes() for x in sets], pa.binary())
            columns["sketch"] = pa.array([(x[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for x in sets], pa.binary())
            yield pa.record_batch(columns)

    return tidy(sketch)


def _full(n_words: int):
    """Texts beside the row and digest that are asked for -> the full set where the digest is the text's."""

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch["text"])
            asked = np.stack([batch[c].to_numpy() for c in ("n", "h1", "h2")], axis=1)
            row = batch["row"].to_numpy()
            for i, j in blocks(offsets):  # sets are larger than texts
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_words)
                same = [k for k, s in enumerate(sets) if len(s) and (len(s), *_digest(s)) == tuple(asked[i + k].tolist())]
                yield pa.record_batch({"row": pa.array(row[i:j][same]), "v": pa.array([sets[k].tobytes() for k in same], pa.binary())})

    return tidy(full)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a sketch's first values."""
    for batch in batches:
        sketches = binaries(batch["low"], np.int64)
        each = pa.array(np.repeat(np.arange(len(sketches)), [len(x) for x in sketches]).astype(np.int64))
        keys = np.concatenate(sketches) if sketches else np.zeros(0, np.int64)
        yield pa.record_batch({"key": pa.array(keys), "row": batch["row"].take(each), "n": batch["n"].take(each)})


def _signatures(column: pa.Array) -> np.ndarray:
    data, offsets = strings(column)
    out = np.zeros((len(column), LISTED), np.uint32)
    sizes = np.diff(offsets) // 4
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(data.tobytes(), np.uint32)
    return out


def _shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the values in each row of x are in that row of y."""
    return ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] != 0)).any(axis=2)


def _streamed(of: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Gives whole lists to `of`: rows come sorted by list, and the last list of a batch may go on in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch["key"].to_numpy()
            if not len(keys):
                continue
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut or (held and held[-1]["key"][-1].as_py() != keys[0]):
                yield from of(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from of(pa.Table.from_batches(held))

    return tidy(run)


def _out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})


def _pairing(threshold: float):
    """Lists of one value -> pairs whose sizes and retained values allow the threshold: all of short lists,
    those with leaders and neighbours of long ones."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row, n = (t[c].to_numpy() for c in ("key", "row", "n"))
        sig = _signatures(t["sig"].combine_chunks())

        def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
            good = np.flatnonzero((small >= threshold * large - 1e-9) & (a != b))
            found = np.zeros(len(a), bool)
            for i in range(0, len(good), 50_000):
                g = good[i : i + 50_000]
                found[g] = _shared(sig[a[g]], sig[b[g]]).sum(axis=1) >= np.minimum(OVERLAP, large[g])
            return found

        starts = np.flatnonzero(np.diff(key, prepend=key[0] + 1 if len(key) else 0))
        sizes = np.diff(np.append(starts, len(key)))
        short = np.repeat(sizes <= SHORT, sizes)
        for d in range(1, SHORT):
            a = np.flatnonzero((key[:-d] == key[d:]) & short[:-d]) if len(key) > d else np.zeros(0, np.int64)
            if not len(a):
                break
            good = fits(a, a + d)
            yield _out(row[a[good]], row[a[good] + d])
        for s, m in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
            every = np.arange(s, s + m)
            order = np.argsort(mix(row[every].view(np.uint64) ^ key[s : s + 1].view(np.uint64)))
            some = [(np.full(m, s + leader), every) for leader in order[:LEADERS]] + [(every[:-d], every[d:]) for d in range(1, NEIGHBOURS + 1)]
            for a, b in some:
                good = fits(a, b)
                yield _out(row[a[good]], row[b[good]])

    return _streamed(of)


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each three of the long lists that a text is on."""
    for batch in batches:
        keys = [np.unique((np.array(k, np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)) for k in batch["keys"].to_pylist()]
        three = [np.array(list(combinations(range(len(k)), 3)), np.int64).reshape(-1, 3) for k in keys]
        sizes = np.array([len(x) for x in three], np.int64)
        picked = np.concatenate([k[x] for k, x in zip(keys, three)]) if len(keys) else np.zeros((0, 3), np.uint32)
        wide = picked.astype(np.uint64)
        hashed = mix(mix(mix(wide[:, 0]) * _ODD + wide[:, 1]) * _ODD + wide[:, 2])
        each = pa.array(np.repeat(np.arange(len(keys)), sizes))
        out = {c: batch[c].take(each) for c in ("row", "n", "own", "comp")}
        out |= {"key": pa.array(hashed.view(np.int64)), "three": pa.array([x.tobytes() for x in picked], pa.binary()), "sig": pa.array([k.tobytes() for k in keys], pa.binary()).take(each)}
        yield pa.record_batch({c: out[c] for c in ("key", "row", "n", "own", "comp", "three", "sig")})


def _crossing(threshold: float):
    """Lists of three values -> all pairs across components that may reach the threshold, each on the list of its
    three smallest shared values alone. `own` of a text's shingles are in no other text of these lists.
    Where a component has very many texts on a list, the others ask for the component (asks: b is its root), and
    where very many texts are outside of the largest component, they ask for each other (b is -1)."""

    def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, row, n, own, comp = (t[c].to_numpy() for c in ("key", "row", "n", "own", "comp"))
        sig = _signatures(t["sig"].combine_chunks())
        three = np.frombuffer(b"".join(t["three"].to_pylist()), np.uint32).reshape(-1, 3)
        starts = np.flatnonzero(np.diff(key, prepend=key[0] + 1 if len(key) else 0))
        asked: set[tuple[int, int]] = set()
        done = np.zeros(len(row), bool)  # on the list at hand: asks for -1
        for s, e in zip(starts.tolist(), np.append(starts[1:], len(key)).tolist()):
            names, at = np.unique(comp[s:e], return_inverse=True)
            if len(names) == 1:
                continue
            most = np.bincount(at).argmax()
            rest = s + np.flatnonzero(at != most)
            every = np.concatenate([s + np.flatnonzero(at == most), rest])
            first = len(every) - len(rest)
            many = len(rest) >= CROWD
            if many:
                done[rest] = [(r, -1) in asked for r in row[rest].tolist()]
            for k, u in enumerate(rest.tolist()):
                low = first * ((int(row[u]), int(names[most])) in asked)
                v = every[low : first + k]  # the largest component, and those of the others that came before
                if many and done[u]:  # those that ask too are met there; who doesn't ask yet still has to
                    v = v[(comp[v] == names[most]) | ~done[v]]
                v = v[comp[v] != comp[u]]
                shared = np.minimum(n[u] - own[u], n[v] - own[v])
                v = v[shared >= threshold * (n[u] + n[v] - shared) - 1e-9]
                for i in range(0, len(v), 50_000):
                    w = v[i : i + 50_000]
                    x = np.broadcast_to(sig[u], (len(w), LISTED))
                    both = _shared(x, sig[w])
                    least = np.argsort(~both, axis=1, kind="stable")[:, :3]
                    hit = w[(both.sum(axis=1) >= 3) & (np.take_along_axis(x, least, axis=1) == three[u]).all(axis=1)]
                    near = comp[hit] == names[most]
                    asks = [(int(row[u]), int(names[most]))] if first >= CROWD and near.any() else []
                    asks += [(int(row[j]), -1) for j in [u, *hit[~near].tolist()]] if many and not near.all() else []
                    asks = [x for x in dict.fromkeys(asks) if x not in asked]
                    asked.update(asks)
                    if many and not near.all():
                        done[u] = done[hit[~near]] = True
                    yield out([a for a, _ in asks], [b for _, b in asks], True)
                    hit = hit[~((near & (first >= CROWD)) | (~near & many))]
                    yield out(np.minimum(row[hit], row[u]), np.maximum(row[hit], row[u]), False)

    def out(a, b, asks: bool) -> pa.RecordBatch:
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "asks": pa.array([asks] * len(a), pa.bool_())})

    return _streamed(of)


def _matcher(held, threshold: float):
    """Members of components with their full sets -> links to the texts of one block that ask for them."""
    percent = round(100 * threshold)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, sets, asks = held.value
        sizes = np.array([len(x) for x in sets], np.int64)
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        for batch in batches:
            for row, comp, own in zip(batch["row"].to_pylist(), batch["comp"].to_pylist(), binaries(batch["v"], np.uint64)):
                low, high = np.searchsorted(hashes, own), np.searchsorted(hashes, own, "right")
                shared = np.bincount(owner[ragged(low, high - low)], minlength=len(sets))
                good = np.flatnonzero((100 * shared >= percent * (sizes + len(own) - shared)) & asks[comp] & (rows != row))
                if len(good):
                    yield _out(rows[good], np.full(len(good), row))

    return tidy(match)


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = binaries(batch["v"], np.int64)
        each = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.int64))
        yield pa.record_batch({"row": batch["row"].take(each), "h": pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))})


def _estimate(threshold: float):
    """Pairs with both sketches (the upper halves of the smallest hashes) -> those whose union's sketch allows the threshold."""
    least = threshold - 4.5 * (threshold * (1 - threshold) / SKETCH) ** 0.5

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, near = [], []
            for i, (x, y) in enumerate(zip(binaries(batch["x"], np.uint32), binaries(batch["y"], np.uint32))):
                every, counts = np.unique(np.concatenate([x, y]), return_counts=True)
                shared = (counts[:SKETCH] == 2).mean()
                if shared >= least:
                    keep.append(i)
                    near.append(float(shared))
            at = pa.array(keep, pa.int64())
            yield pa.record_batch({"a": batch["a"].take(at), "b": batch["b"].take(at), "near": pa.array(near, pa.float64())})

    return tidy(estimate)


def _confirm(threshold: float):
    percent = round(100 * threshold)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(binaries(batch["x"], np.uint64), binaries(batch["y"], np.uint64))):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.record_batch({"a": batch["a"].take(at), "b": batch["b"].take(at)})

    return tidy(confirm)


def _with_both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs: a, b; held (dealt out by row): row, v. Out: a, b, x, y with the values of both. Only pairs are shuffled, for the
    second end with the first one's value. A row is in few pairs, as lists are read in shares of bounded size."""
    for end, name in (("b", "y"), ("a", "x")):
        pairs = pairs.join(held.select(F.col("row").alias(end), F.col("v").alias(name)).hint("merge"), end)
    return pairs.select("a", "b", "x", "y")


class _Linker:
    def __init__(self, docs: DataFrame, n_words: int, threshold: float, row_id: str | None = None):
        self.docs, self.n_words, self.threshold = docs.select("doc_id", "text"), n_words, threshold
        self.links: list[DataFrame] = []
        self.roots, self.seen = None, 0
        rows = docs.select("doc_id", "text", (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row"))
        self.sketched = stage(rows.mapInArrow(_sketch(n_words), "row long, doc_id long, n long, h1 long, h2 long, low binary, sketch binary"), "sketches")
        key = ["n", "h1", "h2"]
        classes = self.sketched.where("n > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc_id").alias("first_id"), F.count("*").alias("w"))
        self.classes = stage(classes, "classes")
        dealt = self.sketched.repartition(workers(docs.sparkSession), "row")
        dealt = dealt.join(self.classes.select(F.col("rep").alias("row")).hint("merge"), "row", "left_semi")
        self.nodes = bucketed(dealt, "row", "nodes", dealt=True)

    def joined(self) -> DataFrame:
        """node, root by the links so far."""
        if not self.links:
            return self.nodes.select(F.col("row").alias("node"), F.col("row").alias("root")).limit(0)
        if self.seen < len(self.links):
            new = self.links[self.seen :]
            edges = new[0]
            for more in new[1:]:
                edges = edges.union(more)
            if self.roots is not None:  # components so far are stars, which fall together in one round
                edges = edges.union(self.roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
            self.roots, self.seen = components(edges), len(self.links)
        return self.roots

    def across(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a table) whose ends aren't in one component yet."""
        roots = self.joined()
        for end in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
        return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).drop("root_a", "root_b")

    def resolve(self, pairs: DataFrame) -> None:
        """Adds those of the candidates that are links, as far as components need them."""
        pairs = stage(pairs.distinct(), "pairs")
        held = self.nodes.select("row", F.col("sketch").alias("v"))
        near = stage(_with_both(pairs, held).mapInArrow(_estimate(self.threshold), "a long, b long, near double"), "near")
        release(pairs)
        open_ = stage(self.across(near), "open") if self.links else near
        if open_.isEmpty():
            return
        sets = self.sets(open_.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        best = [open_.groupBy(x).agg(F.max_by(y, "near").alias(y)).select("a", "b") for x, y in ("ab", "ba")]
        first = stage(best[0].union(best[1]).distinct(), "first")
        self.confirm(first, sets)
        rest = stage(self.across(open_.select("a", "b").join(first, ["a", "b"], "left_anti")), "rest")
        if not rest.isEmpty():
            self.confirm(rest, sets)
        release(sets, first, rest)

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> None:
        self.links.append(stage(_with_both(pairs, sets).mapInArrow(_confirm(self.threshold), "a long, b long"), "links"))

    def sets(self, rows: DataFrame) -> DataFrame:
        """row, v: full sets of these rows, dealt out by row, from another pass over their texts alone."""
        wanted = stage(self.nodes.select("row", "doc_id", "n", "h1", "h2").join(rows.hint("merge"), "row", "left_semi"), "wanted")
        asked = wanted.withColumnRenamed("doc_id", "_id")
        if wanted.count() <= BROADCAST_IDS:
            asked = F.broadcast(asked)
        texts = self.docs.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")))
        out = bucketed(texts.select("text", "row", "n", "h1", "h2").mapInArrow(_full(self.n_words), "row long, v binary"), "row", "sets")
        release(wanted)
        return out

    def paired(self, entries: DataFrame) -> DataFrame:
        """entries: key, row, n, w (the list's length)."""
        # A very long list is read in shares, each with leaders of its own; other lists deal the same texts out differently.
        share = F.when(F.col("w") > 2 * SHARE, F.xxhash64(F.col("key"), F.pmod(F.xxhash64("row", "key"), F.ceil(F.col("w") / SHARE)))).otherwise(F.col("key"))
        signed = self.nodes.select("row", F.expr(f"substring(sketch, 1, {4 * LISTED})").alias("sig")).hint("merge")
        entries = entries.join(signed, "row").select(share.alias("key"), "row", "n", "sig")
        entries = entries.repartition(workers(entries.sparkSession), "key").sortWithinPartitions("key", "sig")
        return entries.mapInArrow(_pairing(self.threshold), "a long, b long")

    def listed(self, entries: DataFrame, least: int) -> DataFrame:
        """Those of entries (key, row, comp and others) whose list has `least` rows at least and joins several components, with its length."""
        lists = entries.groupBy("key").agg(F.count("*").alias("w"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        lists = stage(lists.where((F.col("w") >= least) & (F.col("low") != F.col("high"))).select("key", F.col("w"), F.lit(1).alias("found")), "lists")
        out = stage(join_unique(entries, lists, ["key"], "w", small=0).where("found = 1").drop("found"), "listed")
        release(lists)
        return out

    def own_shingles(self, rows: DataFrame) -> DataFrame:
        """row, own: how many of its shingles are in no other of these rows."""
        single = self.sets(rows).mapInArrow(_exploded, "row long, h long").groupBy("h").agg(F.count("*").alias("c"), F.min("row").alias("row")).where("c = 1")
        return stage(single.groupBy("row").agg(F.count("*").alias("own")), "own")

    def run(self) -> None:
        entries = self.nodes.select("row", "n", "low").mapInArrow(_lists, "key long, row long, n long").withColumn("comp", F.col("row"))
        listed = self.listed(entries, 2)
        self.resolve(self.paired(listed))
        # Long lists that still join several components: all pairs across components that share three of them
        # (a pair that shares another list has been met there, or is in one component by now).
        roots = self.joined().select(F.col("node").alias("row"), "root")
        long = listed.where(F.col("w") > SHORT).drop("comp", "w").join(roots, "row", "left").withColumn("comp", F.coalesce("root", "row")).drop("root")
        long = self.listed(long, SHORT + 1)
        texts = long.groupBy("row").agg(F.first("n").alias("n"), F.first("comp").alias("comp"), F.collect_set("key").alias("keys"))
        texts = stage(texts.where(F.size("keys") >= OVERLAP), "on-long-lists")
        if texts.isEmpty():
            return
        own = self.own_shingles(texts.select("row"))
        texts = texts.join(own, "row", "left").withColumn("own", F.coalesce("own", F.lit(0)).cast("long"))
        schema = "key long, row long, n long, own long, comp long, three binary, sig binary"
        finer = self.listed(texts.repartition(workers(texts.sparkSession)).select("row", "n", "own", "comp", "keys").mapInArrow(_triples, schema), 2)
        if finer.isEmpty():
            return
        sorted_ = finer.repartition(workers(finer.sparkSession), "key").sortWithinPartitions("key")
        met = stage(sorted_.select("key", "row", "n", "own", "comp", "three", "sig").mapInArrow(_crossing(self.threshold), "a long, b long, asks boolean").distinct(), "met")
        self.resolve(met.where("not asks").select("a", "b"))
        self.answer(met.where("asks").select("a", "b"), texts.select("row", "comp"))

    def answer(self, asks: DataFrame, texts: DataFrame, block: int = 2000) -> None:
        """Adds the links of texts (a) with any member of the components (b) that they ask for: the asking texts, in
        blocks, against all members."""
        asking = asks.select(F.col("a").alias("row")).distinct()
        n = -(-asking.count() // block)
        if not n:
            return
        members = texts.join(asks.select(F.col("b").alias("comp")).distinct(), "comp", "left_semi").select("row", "comp")
        members = members.union(asks.where("b = -1").select(F.col("a").alias("row"), F.col("b").alias("comp")))
        members = stage(self.sets(members.select("row").distinct()).join(members, "row").select("row", "comp", "v"), "members")
        sets = self.sets(asking)
        for i in range(n):
            mine = sets.where(F.pmod(F.xxhash64("row"), F.lit(n)) == i).toArrow()  # about `block` sets
            if not len(mine):
                continue
            place = {r: k for k, r in enumerate(mine["row"].to_pylist())}
            wanted: dict[int, np.ndarray] = {}
            for r in asks.where(F.pmod(F.xxhash64("a"), F.lit(n)) == i).toLocalIterator():
                wanted.setdefault(r["b"], np.zeros(len(place), bool))[place[r["a"]]] = True
            held = asks.sparkSession.sparkContext.broadcast((np.array(list(place), np.int64), [np.frombuffer(x, np.uint64) for x in mine["v"].to_pylist()], wanted))
            some = members.where(F.col("comp").isin(list(wanted)))
            self.links.append(stage(some.repartition(workers(asks.sparkSession)).mapInArrow(_matcher(held, self.threshold), "a long, b long"), "links"))


def near_dedup(docs: DataFrame, n_words: int = 5, threshold: float = 0.8, row_id: str | None = None) -> DataFrame:
    """docs: doc_id, text, and in the column `row_id`, where one is named, a number of its own for each row. Out, for each row:
    doc_id, n_shingles, component_id, kept, row, and root: the same number for all rows of a component."""
    linker = _Linker(docs, n_words, threshold, row_id)
    linker.run()
    roots = linker.joined().select(F.col("node").alias("rep"), "root")
    classes = linker.classes.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    firsts = classes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("classes"))
    classes = join_unique(classes.select("n", "h1", "h2", "w", "root"), firsts, ["root"], "classes")
    classes = stage(classes.select("n", "h1", "h2", "w", "component_id", "root"), "class-components")
    out = join_unique(linker.sketched.select("row", "doc_id", "n", "h1", "h2"), classes, ["n", "h1", "h2"], "w")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "row", F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("row")).alias("root"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), 3, 0.85).select("doc_id", "n_shingles", "component_id", "kept")


def brute_force(texts: dict[int, str | None], n_words: int, percent: int, find: Callable | None = None) -> dict[int, tuple[int, int]]:
    """doc_id -> (set size, component), by comparing all pairs: for tests on small tables."""
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)} if len(w) >= n_words else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                shared = len(x & y)
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {d: (len(sets[d]), root(d)) for d in ids}
