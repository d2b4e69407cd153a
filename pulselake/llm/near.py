"""MinHash banding with odd-sketch screening and exact confirmation, for documents and for paragraphs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import LIGHT_BYTES, components, cut, light_bytes, text_key, tidy
from ._text import mix, pieces, text_shingles


@dataclass(frozen=True)
class Banding:
    """``percent``: least Jaccard similarity of a link. ``bands`` of ``rows`` MinHash values each: a pair at
    0.8 is found with probability 1 - (1 - 0.8**rows)**bands, 0.999998 by default. ``sketch_limit``: pairs whose odd
    sketches of 256 bits differ in more bits are no candidates; a pair at 0.8 differs in 34 on average
    with a deviation of 6."""

    shingle: int = 5
    percent: int = 80
    bands: int = 25
    rows: int = 4
    sketch_limit: int = 66


_SEED = mix(np.arange(1, 4097, dtype=np.uint64))


def minhashes(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) MinHash values; rows without hashes hold the largest value."""
    full = np.flatnonzero(np.diff(offsets) > 0)
    out = np.full((len(offsets) - 1, n), np.uint64(0xFFFFFFFFFFFFFFFF))
    if len(full):
        at = offsets[:-1][full]
        for i in range(n):
            out[full, i] = np.minimum.reduceat((hashes ^ _SEED[i]) * (_SEED[i + 2048] | np.uint64(1)), at)
    return out


def odd_sketches(values: np.ndarray, words: int = 4) -> np.ndarray:
    """(rows, words) 64-bit parity bitmaps: every (position, MinHash value) flips one bit."""
    n, k = values.shape
    bit = mix(values ^ _SEED[None, 1024 : 1024 + k]) % np.uint64(64 * words)
    out = np.zeros((n, words), np.uint64)
    r = np.repeat(np.arange(n), k)
    b = bit.ravel()
    np.bitwise_xor.at(out, (r, (b >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (b & np.uint64(63)))
    return out


def estimated_jaccard(differing_bits: float, samples: int, bits: int = 256) -> float:
    """Similarity that the population count of the XOR of two odd sketches stands for."""
    return 1 + bits / (4 * samples) * np.log(max(1e-9, 1 - 2 * differing_bits / bits))


def _sets(column: pa.Array, k: int) -> list[np.ndarray]:
    h, off = text_shingles(column, k)
    return [np.unique(h[off[i] : off[i + 1]]) for i in range(len(column))]


def signatures(units: DataFrame, how: Banding, id_col: str, text_col: str) -> DataFrame:
    """(uid, n, set_key, bands, s0..s3): size and fingerprint of the shingle set, band keys and odd sketch of each row."""
    kind = units.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, text_col):
                sets = _sets(b.column(1), how.shingle)
                off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
                values = minhashes(np.concatenate(sets) if sets else np.zeros(0, np.uint64), off, how.bands * how.rows)
                keys = np.zeros((len(sets), how.bands), np.uint64)
                for j in range(how.rows):
                    keys = mix(keys * np.uint64(0x100000001B3) + values[:, j :: how.rows] + np.uint64(j))
                keys = mix(keys + np.arange(how.bands, dtype=np.uint64)[None, :])
                sketch = odd_sketches(values).view(np.int64)
                full = np.diff(off) > 0
                per = np.where(full, how.bands, 0)
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(keys[full].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(np.diff(off)), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), bands, *(pa.array(sketch[:, i]) for i in range(4))],
                    ["uid", "n", "set_key", "bands", "s0", "s1", "s2", "s3"],
                )

    return units.select(id_col, text_col).mapInArrow(run, f"uid {kind}, n long, set_key binary, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def confirm(pairs: DataFrame, texts: DataFrame, how: Banding) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full shingle sets, made from ``texts(node, text)``, are similar enough."""
    t = texts
    both = pairs.join(t.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(t.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for big in batches:
                for b in (c for half in pieces(iter([big]), "ta") for c in pieces(iter([half]), "tb")):
                    ok = []
                    for x, y in zip(_sets(b.column("ta"), how.shingle), _sets(b.column("tb"), how.shingle)):
                        both_have = len(np.intersect1d(x, y, assume_unique=True))
                        ok.append(both_have > 0 and 100 * both_have >= how.percent * (len(x) + len(y) - both_have))
                    yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_classes(units: DataFrame, how: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(uid, n, component, members) for every row of ``units``; rows with equal shingle sets are one node.

    Candidates share a band key, pass a length test and the odd-sketch screen, and are confirmed on the full sets;
    see ``linked_classes``. Null and empty texts and texts without words have n = 0 and link with nothing.
    """
    source = units.select(F.col(id_col).alias("uid"), F.col(text_col).alias("text"))

    def finish(members: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
        rows = nodes.select("node", "n", "bands").join(shingle_sets(texts.join(_light(nodes.select("node")), "node"), how), "node")
        return open_links(members.join(rows, "node"), how)

    def fetch(wanted: DataFrame) -> DataFrame:
        return _only_own(source.join(wanted, source.uid.eqNullSafe(wanted.uid)).select("node", "set_key", "text"), how).dropDuplicates(["node"])

    return linked_classes(signatures(units, how, id_col, text_col), fetch, ["n", "bands", "s0", "s1", "s2", "s3"], lambda a, b: _alike(how, a, b), lambda pairs, texts: confirm(pairs, texts, how), finish)


def _light(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its bytes, counted, are few enough; the joins' results are the same."""
    return F.broadcast(df) if light_bytes(df) <= LIGHT_BYTES else df


@tidy
def linked_classes(sig: DataFrame, fetch, features: list[str], alike, confirmed, finish, turns: int = 1, meet=None) -> DataFrame:
    """(uid, n, component, members) for every row of ``sig(uid, n, set_key, features...)``; the feature ``bands`` is the array of a row's band keys.

    Rows with one ``set_key`` are one node; only nodes that have a key in common with another one go on. First every node of a bucket (one band key) is
    paired with the bucket's smallest node; then, in buckets that still hold several components, with a pseudo-random
    one, for ``turns`` turns at most or until few pairs are open; at last all open pairs, those of nodes in
    different components. ``alike(a, b)`` screens pairs by the columns with these prefixes; ``confirmed(pairs, texts)``
    keeps the true ones by whole texts; ``fetch(wanted)`` gives (node, text) of ``wanted(node, uid, set_key)``, texts that are
    the node's only, each once; ``finish(members, nodes, texts)`` gives the links among open pairs in the last step, from (key, m, node, root), the nodes' rows and texts;
    ``meet(rows)``, if given, finds the rows (mark, key) of keys that several marks have, from (mark, bands). So a bucket of one group costs about as many pairs as it has members, and no link between different
    components is passed over. ``component`` is the smallest uid reachable over links, the row's own included; ``members`` counts the component's rows.

    Rows with n = 0 link with nothing; a null uid never becomes a component's id
    unless the component has no other; repeated rows and ids are rows of their own; an empty table gives an empty one.
    """
    sig = cut(sig.withColumn("row", F.monotonically_increasing_id()), "signatures")
    keyed = cut(sig.where("n > 0").groupBy("set_key").agg(F.min("row").alias("node"), F.min("uid").alias("least"), F.count("*").alias("c")), "nodes")
    # sets are told apart by 64 bits of their fingerprint when it comes to what keys are shared
    mark = F.xxhash64("set_key").alias("mark")
    if meet:
        touched = cut(meet(sig.where("n > 0").select(mark, "bands")), "touched")
        inside = _light(cut(touched.select("mark").distinct(), "sets"))
        reps = _light(cut(keyed.select("node", "set_key", mark).join(inside, "mark"), "touched-nodes"))
        crowd = cut(touched.join(reps, "mark").select("key", "node"), "crowd")
        reps = _light(reps.select("node"))
    else:
        spread = sig.where("n > 0").select("set_key", F.explode("bands").alias("key"))
        shared = spread.groupBy("key").agg(F.min(F.xxhash64("set_key")).alias("x"), F.max(F.xxhash64("set_key")).alias("y")).where("x <> y").select("key")
        touched = cut(spread.join(_light(cut(shared, "shared")), "key").distinct(), "touched")
        inside = _light(cut(touched.select("set_key").distinct(), "sets"))
        reps = _light(cut(keyed.join(inside, "set_key").select("node", "set_key"), "touched-nodes"))
        crowd = cut(touched.join(reps, "set_key").select("key", "node"), "crowd")
    reps = cut(sig.join(reps.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "uid", "set_key", *features), "reps")
    sketches = reps.select("node", *(c for c in features if c != "bands"))
    pairs = crowd.join(_light(cut(crowd.groupBy("key").agg(F.min("node").alias("a")), "smallest")), "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    def screened(p: DataFrame) -> DataFrame:
        x = sketches.select(F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in sketches.columns[1:]))
        y = sketches.select(F.col("node").alias("b"), *(F.col(c).alias(f"b_{c}") for c in sketches.columns[1:]))
        return p.join(x, "a").join(y, "b").where(alike("a_", "b_")).select("a", "b")

    pairs = cut(screened(pairs), "pairs")

    # the texts of all nodes in shared buckets, once: the nodes go to the scan if they are few, else both sides are shuffled
    wanted = _light(cut(reps.select("node", "uid", "set_key"), "wanted"))
    texts = cut(fetch(wanted), "texts")

    links = cut(confirmed(pairs, texts), "confirmed")
    roots = cut(components(links), "roots")

    tested = pairs
    for turn in range(turns + 1):
        held = crowd.join(_light(roots.withColumnRenamed("id", "node")), "node", "left").withColumn("root", F.coalesce("root", "node"))
        shares = held.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        mixed = cut(shares.where("m * m > own").select("key", "m", ((F.col("m") * F.col("m") - F.col("own")) / 2).alias("open")), "mixed")
        left = mixed.agg(F.coalesce(F.sum("open"), F.lit(0.0)), F.coalesce(F.sum("m"), F.lit(0))).first()
        if not left[0]:
            break
        last = turn == turns or left[0] <= 4 * left[1]
        members = cut(held.join(_light(mixed.select("key", "m")), "key"), "members")
        wanted = _light(cut(members.select("node").distinct(), "open"))
        if last:
            links = links.union(cut(finish(members, cut(reps.join(wanted, "node"), "open-nodes"), texts), "confirmed"))
            roots = cut(components(links), "roots")
            break
        members = cut(members.drop("m").join(sketches.join(wanted, "node"), "node"), "members")
        chance = F.xxhash64("node", F.lit(turn))
        centre = members.groupBy("key").agg(F.min(chance).alias("chance"))
        named = [c for c in members.columns if c != "key"]
        x = members.join(centre, "key").where(chance == F.col("chance")).select("key", *(F.col(c).alias(f"a_{c}") for c in named))
        y = members.select("key", *(F.col(c).alias(f"b_{c}") for c in named))
        across = x.join(y, "key").where((F.col("a_root") != F.col("b_root")) & alike("a_", "b_"))
        across = across.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()
        across = cut(across.join(tested, ["a", "b"], "left_anti"), "across")
        links = links.union(cut(confirmed(across, texts), "confirmed"))
        roots = cut(components(links), "roots")
        tested = tested.union(across)

    # what stands alone needs no class: its row is its own
    named = keyed.join(_light(roots.withColumnRenamed("id", "node")), "node", "left")
    several = named.where("root is not null").groupBy("root").agg(F.min("least").alias("component"), F.sum("c").alias("members"))
    linked = named.where("root is not null").join(several, "root").select("set_key", "component", "members")
    alone = named.where("root is null and c > 1").select("set_key", F.col("least").alias("component"), F.col("c").alias("members"))
    classes = _light(cut(linked.union(alone), "classes"))
    out = sig.select("uid", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key")).join(classes, "set_key", "left")
    own_row = F.col("members").isNull()
    return out.select("uid", "n", F.when(own_row, F.col("uid")).otherwise(F.col("component")).alias("component"), F.when(own_row, 1).otherwise(F.col("members")).alias("members"))


def _alike(how: Banding, a: str, b: str):
    """Sizes that allow the similarity, and odd sketches that don't speak against it."""
    bits = [F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(4)]
    sizes = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * how.percent
    return sizes & (bits[0] + bits[1] + bits[2] + bits[3] <= how.sketch_limit)


#: 64-bit words of the sharper odd sketches.
FINE_WORDS = 32


def shingle_sets(texts: DataFrame, how: Banding) -> DataFrame:
    """(node, shingles) of ``texts(node, text)``: the sorted 64-bit hashes of the shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in _sets(b.column("text"), how.shingle)], pa.binary())], ["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def fine_sketch(shingles: np.ndarray) -> np.ndarray:
    """An odd sketch of FINE_WORDS words into which every shingle is folded.

    The bits in which two of them differ tell the size of the symmetric difference of the whole sets, without the sampling error of
    MinHash.
    """
    odd = np.bincount((mix(shingles ^ _SEED[7]) % np.uint64(64 * FINE_WORDS)).astype(np.int64), minlength=64 * FINE_WORDS) % 2
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def fine_limit(percent: int):
    """Bits in which sketches of sets of two sizes at the threshold differ, plus five deviations."""
    bits = 64.0 * FINE_WORDS

    def most(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = (x + y) * ((100 - percent) / (100 + percent))
        full = np.exp(-4 * d / bits)
        return (1 - np.exp(-2 * d / bits)) * bits / 2 + 5 * np.sqrt(np.maximum(1.0, (1 - full) * bits / 4 - d * full)) + 1

    return most


#: Members of a bucket that meet in one task; larger buckets are compared block by block.
BLOCK = 8192


def in_blocks(members: DataFrame, compare, schema: str, after=iter) -> DataFrame:
    """The batches that ``compare`` makes of ``members(key, m, node, …)``: of a bucket's rows at once (a pa.Table with ``own``, the row's block, and i and j, the blocks that meet).

    Buckets of more than BLOCK members are cut into blocks, and every two blocks meet in a task of their own, so that no task holds more than two blocks.
    ``after`` takes the stream of a task's batches before it leaves the task.
    """
    k = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), k).cast("int")
    other = F.explode(F.sequence(F.lit(0), k - 1))
    spread = members.withColumn("k", k).withColumn("own", own).withColumn("other", other)
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *(c for c in members.columns if c not in ("key", "m")))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = [], None
        for b in batches:
            marks = np.stack([b.column(c).to_numpy() for c in ("key", "i", "j")], 1)
            edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), b.num_rows] if b.num_rows else [0]
            for x, y in zip(edges, edges[1:]):
                if held and tuple(marks[x]) != mark:
                    yield from compare(pa.concat_tables(held))
                    held = []
                mark = tuple(marks[x])
                held.append(pa.Table.from_batches([b.slice(x, y - x)]))
        if held:
            yield from compare(pa.concat_tables(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            yield from after(buckets(batches))

    return spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def meeting(t: pa.Table, percent: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a bucket or of two of its blocks, of different roots and with sizes ``n`` that allow the similarity; every pair of nodes once. ``width``: bytes that the caller needs for a pair."""
    node, root, n, own = (t.column(c).to_numpy() for c in ("node", "root", "n", "own"))
    apart = t.column("i")[0].as_py() != t.column("j")[0].as_py()
    step = max(1, (16 << 20) // (len(node) * width))
    for at in range(0, len(node), step):
        r = slice(at, at + step)
        ok = (root[r, None] != root[None, :]) & (node[r, None] < node[None, :])
        if apart:
            ok &= own[r, None] != own[None, :]
        ok &= np.minimum(n[r, None], n[None, :]) * 100 >= np.maximum(n[r, None], n[None, :]) * percent
        x, y = np.nonzero(ok)
        yield x + at, y


def open_links(members: DataFrame, how: Banding) -> DataFrame:
    """(a, b): true links among ``members(key, m, node, root, n, bands, shingles)`` in one bucket, of different roots.

    A pair is compared, on the full sets, in the first bucket that it shares only, and not if links found in its task connect it already; so a task
    hands on fewer links than it has members, and every true link's ends are connected.
    """
    most = fine_limit(how.percent)

    def compare(t: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        key, node, n, root = t.column("key")[0].as_py(), *(t.column(c).to_numpy() for c in ("node", "n", "root"))
        bands = np.stack([np.array(x, np.int64) for x in t.column("bands").to_pylist()])
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        fine = np.stack([fine_sketch(x) for x in sets])
        for x, y in meeting(t, how.percent, fine.shape[1] * 8):
            for cut_at in range(0, len(x), 100_000):
                p, q = x[cut_at : cut_at + 100_000], y[cut_at : cut_at + 100_000]
                apart = np.bitwise_count(fine[p] ^ fine[q]).sum(1)
                near = apart <= most(n[p], n[q])
                p, q, apart = p[near], q[near], apart[near]
                first = bands[p, (bands[p] == bands[q]).argmax(1)] == key
                p, q = p[first], q[first]
                order = np.argsort(apart[first], kind="stable")
                yield zip(p[order].tolist(), q[order].tolist()), node, root, sets

    def links(found) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for pairs, node, root, sets in found:
            out_a, out_b = [], []
            for i, j in pairs:
                a, b = top(int(root[i])), top(int(root[j]))
                if a == b:
                    continue
                x, y = sets[i], sets[j]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and 100 * both >= how.percent * (len(x) + len(y) - both):
                    parent[max(a, b)] = min(a, b)
                    out_a.append(int(node[i]))
                    out_b.append(int(node[j]))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return in_blocks(members, compare, "a long, b long", links)


def _only_own(texts: DataFrame, how: Banding) -> DataFrame:
    """(node, text) of the rows of ``texts(node, set_key, text)`` that have the node's own set: several texts may bear one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in pieces(batches, "text"):
                own = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(_sets(b.column("text"), how.shingle), b.column("set_key").to_pylist())]
                yield b.select(["node", "text"]).filter(pa.array(own, pa.bool_()))

    return texts.mapInArrow(run, "node long, text string")


def near_duplicates(docs: DataFrame, how: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``; see ``near_classes`` for nulls, ties and repeated rows."""
    found = near_classes(docs, how, id_col, text_col)
    return found.select(F.col("uid").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("uid").eqNullSafe(F.col("component")).alias("kept"))


@tidy
def drop_near_duplicates(docs: DataFrame, how: Banding = Banding(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, the one with the smallest id (null the largest); all columns stay.

    Rows are told apart by id and text, so a repeated or null id neither drops nor saves its other texts. Texts without words
    are no group and all stay. Rows that repeat a kept id and text count once.
    """
    name = F.struct(F.col(id_col).isNull().alias("missing"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"))
    found = cut(near_classes(docs.select(name.alias("uid"), F.col(text_col).alias("text")), how, "uid", "text"), "found")
    kept = (F.col("n") == 0) | (F.col("uid") == F.col("component"))
    gone = found.where(~kept).select(F.col("uid.id").alias("_id"), F.col("uid.key").alias("_key")).distinct()
    out = docs.join(gone, docs[id_col].eqNullSafe(gone["_id"]) & (text_key(docs[text_col]) == gone["_key"]), "left_anti")
    if found.where(kept & (F.col("n") > 0)).groupBy("uid").count().where("count > 1").limit(1).count():
        worded = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        out = out.where(worded).dropDuplicates([id_col, text_col]).union(out.where(~worded))
    return out
