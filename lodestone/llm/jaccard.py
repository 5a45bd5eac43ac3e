"""N-gram Jaccard join: a MinHash LSH forest, then exact verification.

Each text is the set of its runs of five words. In each of TREES trees its label is a string of DEPTH minima. The labels
of a tree, sorted, are a prefix trie: texts below one node share the prefix that leads there. Texts that share FLOOR
minima in some tree meet; from the longest shared prefix, matches are shortened step by step until, by the similarities
of what was found, the matches reach the target recall. FLOOR minima reach it for any data. Within a node, texts are
tied if sketches of all their minima say that they may be similar; so texts that only share a common passage don't
hang together. A node of more than NODE texts is covered by leaders first, and what they leave is split by the next
minimum. Texts with the same set are one class, and one of them stands for all.

Each connected part of what is tied is verified whole: its sets meet in blocks of a bounded number of texts, each block
with each, and all pairs in them are compared exactly. Only counts of links and a spanning forest leave a block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, table
from .components import components
from .exact import kept_rows
from .hashing import buffers, runs, words
from .repeats import by_bucket

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 32, 8, 0.9999
#: Texts below a node that are compared pair by pair; leaders that cover a larger one, level by level; texts below a
#: node that are tied without a comparison, to its least.
NODE, LEADERS, HUGE = 128, 64, 1_000_000
#: Sketches have BITS bits of each minimum. Six standard errors of a similarity estimated by them.
BITS, SLACK = 2, 0.18
#: By a leader's covered texts (in sketches), no other needs to be tried; nearer than LOOSE to a leader are tied to it.
TIGHT, LOOSE = 0.88, 0.5
#: Texts that meet in one task from each of two blocks.
BLOCK = 256
#: Bytes of text whose sets are made at once.
SLAB = 4 << 20

_ODD = (np.random.default_rng(7).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = np.random.default_rng(8).integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold shares one in some tree with probability recall or more."""
    for d in range(depth, 1, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    return 1


def sets(column: pa.Array, k: int = WORDS) -> list[np.ndarray]:
    """For each text, its runs of k words as sorted distinct 64-bit hashes. A text of fewer words, but not none, is one run."""
    raw, bounds = buffers(column)
    out: list[np.ndarray] = []
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + SLAB, "right")) - 1)
        h, start, _ = words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        cut = np.searchsorted(start, bounds[i : j + 1] - bounds[i])
        h = h[:, 0]
        r = runs(h, k)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            out.append(np.unique(r[a : b - k + 1]) if b - a >= k else runs(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
        i = j
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, tree by tree."""
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    low = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 1024):
        y = x[a : a + 1024, None] * _ODD[None, :]
        y ^= y >> np.uint32(15)
        y *= _ADD | np.uint32(1)
        np.minimum(low, y.min(0), out=low)
    return low.astype(np.uint16)


def sketch(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, packed."""
    four = (low & np.uint16(3)).astype(np.uint8).reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches (rows of 64-bit numbers)."""
    z = x ^ y
    differ = np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)
    return 1 - differ / (TREES * DEPTH) / (1 - 0.5**BITS)


def signed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, sha, text) as doc_id, sha, s1, s2 (the set's key), n (its size), labels (null for the empty set), sketch."""
    kind = pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("labels", pa.binary()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                got = sets(part.column("text"))
                named = [set_key(x) for x in got]
                low = [signature(x) if len(x) else None for x in got]
                labels = pa.array([None if x is None else x.astype(">u2").tobytes() for x in low], pa.binary())
                sketches = pa.array([None if x is None else sketch(x).tobytes() for x in low], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("sha"), pa.array([a for a, _ in named], pa.int64()), pa.array([b for _, b in named], pa.int64()), pa.array([len(x) for x in got], pa.int64()), labels, sketches], schema=kind)

    return docs.mapInArrow(run, "doc_id long, sha string, s1 long, s2 long, n long, labels binary, sketch binary")


# -- the forest


def _shared(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many minima labels i and j share from the first on."""
    return np.cumprod(label[i] == label[j], axis=1).sum(1)


def _reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n, the least that edges i-j reach."""
    out = np.arange(n)
    while len(i):
        m = np.minimum(out[i], out[j])
        new = out.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == out).all():
            break
        out = new
    return out


def matches(label: np.ndarray, marks: np.ndarray, new: np.ndarray, depth: int, cut: float) -> tuple[np.ndarray, ...]:
    """(i, j, likeness) of sorted labels that are tied below nodes of the given depth (new: where one begins)."""
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(label)))
    found: list[tuple[np.ndarray, ...]] = []
    small = np.repeat(size <= NODE, size)
    number = np.repeat(np.arange(len(starts)), size)
    for lag in range(1, NODE):
        i = np.flatnonzero((number[lag:] == number[:-lag]) & small[:-lag]) if len(label) > lag else np.empty(0, np.int64)
        if not len(i):
            break
        near = likeness(marks[i], marks[i + lag])
        ok = near >= cut
        found.append((i[ok], i[ok] + lag, near[ok]))
    for k in np.flatnonzero(size > NODE).tolist():
        rows = left = np.arange(starts[k], starts[k] + size[k])
        for _ in range(LEADERS):
            near = likeness(marks[rows], marks[left[:1]])
            ok = (near >= min(LOOSE, cut)) & (rows != left[0])
            found.append((np.full(int(ok.sum()), left[0]), rows[ok], near[ok]))
            left = left[(likeness(marks[left], marks[left[:1]]) < TIGHT) & (left != left[0])]
            if not len(left):
                break
        if len(left) and depth < DEPTH:
            begins = np.concatenate([[True], label[rows[1:], depth] != label[rows[:-1], depth]])
            i, j, near = matches(label[rows], marks[rows], begins, depth + 1, cut)
            found.append((rows[i], rows[j], near))
        elif len(left):
            found.append((np.full(len(left), rows[0]), left, likeness(marks[left], marks[rows[:1]])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix by which a pair at the threshold meets in some tree with probability recall or more: the forest's floor."""
    return next((d for d in range(DEPTH, 1, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


#: Classes of likeness, from the threshold to 1, that found pairs are counted by.
CLASSES = 20


def reached_recall(counts: np.ndarray, depth: int, threshold: float) -> float:
    """The recall that prefixes of the given length reach, by pairs found so (their number by class of likeness, over all trees).

    A pair of similarity s is found in TREES * s^depth trees on average, and missed in all with (1 - s^depth)^TREES.
    """
    s = threshold + (1 - threshold) * np.arange(CLASSES) / CLASSES
    pairs = counts / (TREES * s**depth)
    return 1 - float((pairs * (1 - s**depth) ** TREES).sum() / pairs.sum()) if pairs.sum() else 0.0


def climbed(met: DataFrame, floor: int, threshold: float) -> DataFrame:
    """met: (bucket, tree, label, sketch, node), all below nodes of depth floor. Gives (node, hub, depth): node hangs together with hub by prefixes of depth minima.

    Rows with a node below zero tell how many pairs of a class of likeness share so many minima, no more.
    """
    kind = pa.schema([("node", pa.int64()), ("hub", pa.int64()), ("depth", pa.int32())])

    def run(group: pa.Table) -> pa.Table:
        n = group.num_rows
        raw = b"".join(x.as_py() for x in group.column("label"))
        tree, node = group.column("tree").to_numpy().astype(np.int64), group.column("node").to_numpy()
        label = np.frombuffer(raw, ">u2").astype(np.int64).reshape(n, DEPTH)
        order = np.lexsort((node, *label.T[::-1], tree))  # the sorted trie of each tree
        label, tree, node = label[order], tree[order], node[order]
        marks = np.frombuffer(b"".join(x.as_py() for x in group.column("sketch")), np.uint64).reshape(n, -1)[order]
        new = np.ones(n, bool)
        new[1:] = (tree[1:] != tree[:-1]) | (label[1:, :floor] != label[:-1, :floor]).any(1)
        i, j, near = matches(label, marks, new, floor, threshold - SLACK)
        deep = _shared(label, i, j)
        out, before = [], np.arange(n)
        for d in range(DEPTH, floor - 1, -1):
            use = deep >= d
            hub = _reached(n, i[use], j[use])
            tied = np.bincount(hub, minlength=n)[hub] > 1
            k = np.flatnonzero(tied & ((hub != before) | (np.bincount(before, minlength=n)[before] < 2)))
            out.append((node[k], node[hub[k]], np.full(len(k), d)))
            before = hub
            likely = np.clip(((near[deep == d] - threshold) / (1 - threshold) * CLASSES).astype(np.int64), -1, CLASSES - 1)
            count = np.bincount(likely[likely >= 0], minlength=CLASSES)
            at = np.flatnonzero(count)
            out.append((-1 - at, count[at], np.full(len(at), d)))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(cols, kind.types, strict=True)], schema=kind)

    return met.groupBy("bucket").applyInArrow(run, "node long, hub long, depth int")


#: Rows that meet in one bucket of the forest, more or less.
MET = 50_000


def forest(classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, hub): what hangs together by the forest. classes: (node, labels, sketch, ...), null labels match nothing."""
    floor, width = prefix_length(threshold, recall), 2 * DEPTH
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    key = lambda: F.xxhash64("tree", F.substring("labels", F.col("tree") * width + 1, F.lit(2 * floor)))
    tied = classes.filter("labels is not null").select("node", "labels", trees).select("node", "tree", key().alias("key"))
    nodes = materialize(tied.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("hub")).filter("m > 1"), "trie-nodes")
    met = materialize(tied.join(nodes, "key"), "met")
    rows = met.filter(F.col("m") <= HUGE).count()
    buckets = -(-max(1, rows) // MET)
    full = met.filter(F.col("m") <= HUGE).select("node", "tree", F.pmod("key", F.lit(buckets)).cast("int").alias("bucket")).join(classes.select("node", "labels", "sketch"), "node")
    full = full.select("bucket", "tree", "node", F.substring("labels", F.col("tree") * width + 1, F.lit(width)).alias("label"), "sketch")
    found = materialize(climbed(by_bucket(full, buckets), floor, threshold), "climbed")
    drop(nodes)
    counts = np.zeros((DEPTH + 1, CLASSES))
    for r in found.filter("node < 0").groupBy("depth", "node").agg(F.sum("hub").alias("n")).collect():  # a row for each length and class
        counts[r["depth"], -1 - r["node"]] = r["n"]
    depth = next((d for d in range(DEPTH, floor, -1) if reached_recall(counts[d:].sum(0), d, threshold) >= recall), floor)
    hubs = found.filter((F.col("node") >= 0) & (F.col("depth") >= depth)).select("node", "hub")
    return hubs.unionByName(met.filter(F.col("m") > HUGE).select("node", "hub")).distinct()


# -- exact verification


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) with Jaccard similarity of threshold or more; within left (i < j) if right is None."""
    both = left + (right or [])
    n = len(both)
    size = np.array([len(s) for s in both], np.int64)
    flat = np.concatenate(both) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    held = np.bincount(group) if len(group) else np.empty(0, np.int64)
    common = np.zeros((n, n), np.float32)
    # Runs in many sets: products of 0/1 matrices. Runs in a few: their pairs, by how far apart they stand.
    many = held >= 12
    if many.any():
        number = np.cumsum(many) - 1
        pick = many[group]
        g, o = number[group[pick]], owner[pick]
        for a in range(0, int(many.sum()), 4096):
            s, e = np.searchsorted(g, [a, a + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[o[s:e], g[s:e] - a] = 1
            common += m @ m.T
    few = ~many[group] if len(group) else np.empty(0, bool)
    g, o = group[few], owner[few]
    for lag in range(1, 12):
        same = np.flatnonzero(g[lag:] == g[:-lag]) if len(g) > lag else np.empty(0, np.int64)
        if not len(same):
            break
        common += np.bincount(o[same] * n + o[same + lag], minlength=n * n).reshape(n, n)
    np.fill_diagonal(common, 0)
    i, j = np.nonzero(common)
    swap = i > j
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    pairs = np.unique(i * n + j)
    i, j = pairs // n, pairs % n
    if right is not None:
        cross = (i < len(left)) & (j >= len(left))
        i, j = i[cross], j[cross]
    c = np.maximum(common[i, j], common[j, i])
    ok = c >= threshold * (size[i] + size[j] - c) - 1e-6
    return i[ok], j[ok] - (len(left) if right is not None else 0)


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def verified(placed: DataFrame, threshold: float) -> DataFrame:
    """placed: (task, side, node, runs) with runs the set as bytes. Gives (a, b, n): n links of a, and edges a-b with n 0.

    A node is on side 2 in one task, which gives a row for it even without links.
    """
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        node, side, raw = group.column("node").to_numpy(), group.column("side").to_numpy(), group.column("runs").to_pylist()
        node, at = np.unique(node, return_index=True)  # a document may be repeated
        side = side[at]
        made = [np.frombuffer(raw[k], np.uint64) for k in at]
        cross = side.min() != side.max()
        l, r = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(len(node)), None)
        if (not cross) and int(side[0]) != 2:
            i = j = np.empty(0, np.int64)  # the other block is empty
        else:
            i, j = similar([made[k] for k in l], [made[k] for k in r] if r is not None else None, threshold)
            i, j = l[i], (r if r is not None else l)[j]
        degree = np.bincount(np.concatenate([i, j]), minlength=len(node))
        some = np.flatnonzero((degree > 0) | (side == 2))
        edges = _forest(len(node), i, j)
        a = np.concatenate([node[some], node[[x for x, _ in edges]] if edges else np.empty(0, np.int64)])
        b = [None] * len(some) + [int(node[y]) for _, y in edges]
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.concatenate([degree[some], np.zeros(len(edges), np.int64)]), pa.int64())], schema=kind)

    return placed.groupBy("task").applyInArrow(run, "a long, b long, n long")


def with_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, s1, s2, node, ...) with runs: the sets of the documents named, as bytes.

    Rows that share an id may differ in text, so the set's key tells which is meant.
    """
    joined = docs.join(wanted.withColumnRenamed("doc_id", "wanted_id"), F.col("doc_id").eqNullSafe(F.col("wanted_id")))
    joined = joined.select("text", *[c for c in wanted.columns if c != "doc_id"])
    names = [c for c in joined.columns if c not in ("text", "s1", "s2")]
    kind = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names) + ", runs binary"

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                part = batch.slice(s, 256)
                got = sets(part.column("text"))
                own = list(zip(part.column("s1").to_pylist(), part.column("s2").to_pylist(), strict=True))
                pick = pa.array([k for k, x in enumerate(got) if set_key(x) == own[k]], pa.int64())
                if len(pick):
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(pick) for c in names), pa.array([got[k].tobytes() for k in pick.to_pylist()], pa.binary())], [*names, "runs"])

    return joined.mapInArrow(run, kind)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sha: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, class_id, n_links, set_id, kept; with sha also the text's checksum.

    set_id: the smallest id of those with the same set of runs. n_links: the number of other sets that are similar to
    this one's (Jaccard similarity of threshold or more, verified exactly). class_id: the smallest id in the connected
    part of all links. kept: this row stays for its class, that of the smallest id (of rows that repeat an id, one).
    Texts without words, null ones among them, have the empty set; they are one class without links. A text of fewer
    words than a run, but not none, is one run. A text of any length is read whole, in one task. Repeated rows and ties
    have one set; of rows that are alike in id and set one stays. A null id is larger than all others. Other columns,
    whatever their names, are not read. An empty table gives no rows.
    """
    known = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) if sha else F.lit(None).cast("string")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), known.alias("sha"), F.col(text_col).alias("text"))
    rows = materialize(signed(src).withColumn("rid", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("first")
    # Each class of equal sets is a node, named by the row id of its first row.
    classes = materialize(rows.groupBy("s1", "s2", "n").agg(first, F.first("labels").alias("labels"), F.first("sketch").alias("sketch")).select("s1", "s2", "n", F.col("first.rid").alias("node"), F.col("first.doc_id").alias("doc_id"), "labels", "sketch"), "classes")
    # A text's hubs are joined to the least of them, so the graph has hubs alone as nodes, at most TREES edges for a text.
    hubs = materialize(forest(classes, threshold, recall).groupBy("node").agg(F.min("hub").alias("hub"), F.collect_set("hub").alias("hubs")), "hubs")
    edges = hubs.select(F.col("hub").alias("a"), F.explode("hubs").alias("b")).filter("a <> b").distinct()
    drawn = components(edges).select(F.col("v").alias("hub"), "c")
    parts = materialize(hubs.join(drawn, "hub", "left").select(F.col("node").alias("v"), F.coalesce("c", "hub").alias("c")), "parts-of-hubs")
    drop(hubs)
    sizes = materialize(parts.groupBy("c").agg(F.count("*").alias("m")), "part-sizes")
    total = sizes.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    sized = materialize(parts.join(sizes, "c").select(F.col("v").alias("node"), "c", F.ceil(F.col("m") / block).cast("int").alias("nb")), "parts")
    drop(sizes)
    # A small part goes whole to a task that many share; a large one to a task for each two of its blocks.
    shared = max(1, total // block)
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    meet = F.when(F.col("nb") == 1, F.array(F.struct(F.format_string("s%d", F.pmod(F.xxhash64("c"), F.lit(shared))).alias("task"), F.lit(2).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda o: F.struct(
            F.format_string("%d-%d-%d", F.col("c"), F.least(o, F.col("own")), F.greatest(o, F.col("own"))).alias("task"),
            F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side"))))
    wanted = sized.withColumn("own", own).withColumn("meet", meet).join(classes.select("node", "doc_id", "s1", "s2"), "node").select("doc_id", "s1", "s2", "node", "meet")
    made = with_sets(src, wanted).select("node", "runs", F.explode("meet").alias("m")).select("node", "runs", F.col("m.task").alias("task"), F.col("m.side").alias("side"))
    links = materialize(verified(made, threshold), "links")
    drop(sized)
    met = links.filter("b is null").select("a").distinct().count()
    if met != total:
        raise RuntimeError(f"{total - met} of {total} sets were not made again with the key that they had")
    degree = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    near = components(links.filter("b is not null").select("a", "b")).select(F.col("v").alias("node"), F.col("c").alias("near"))
    named = classes.select("s1", "s2", "n", "node", "doc_id").join(degree, "node", "left").join(near, "node", "left")
    named = materialize(named.select("s1", "s2", "n", "node", F.col("doc_id").alias("set_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("near", "node").alias("near")), "named-sets")
    heads = materialize(named.groupBy("near").agg(F.min(F.struct(F.col("set_id").isNull().alias("last"), "set_id", "node")).alias("head")).select("near", F.col("head.set_id").alias("class_id"), F.col("head.node").alias("keep")), "heads")
    told = materialize(named.join(heads, "near").select("s1", "s2", "n", "set_id", "n_links", "class_id", "keep"), "told")
    drop(links, named, heads)
    out = rows.drop("labels", "sketch").join(told, ["s1", "s2", "n"]).withColumn("kept", F.col("rid") == F.col("keep"))
    return out.select("doc_id", "class_id", "n_links", "set_id", "kept", *["sha"] * sha)


def op2_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


#: All pairs of sets that share a run; recall of the forest is RECALL, so links may differ once in 10,000 at the threshold.
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' ')))) END AS s FROM d),
n AS MATERIALIZED (SELECT min(doc_id) AS set_id, s, len(s) AS size FROM x GROUP BY s),
r AS MATERIALIZED (SELECT set_id, size, unnest(s) AS run FROM n),
p AS (SELECT a.set_id AS a, b.set_id AS b, count(*) AS c, any_value(a.size + b.size) AS sizes FROM r a JOIN r b ON a.run = b.run AND a.set_id <> b.set_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE c >= {THRESHOLD} * (sizes - c) - 1e-6),
reach AS (SELECT set_id AS a, set_id AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS set_id, min(b) AS class_id FROM reach GROUP BY a),
k AS (SELECT a AS set_id, count(*) AS n_links FROM l GROUP BY a)
SELECT x.doc_id, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, n.set_id, x.doc_id = c.class_id AS kept
FROM x JOIN n USING (s) JOIN c ON c.set_id = n.set_id LEFT JOIN k ON k.set_id = n.set_id
"""


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay for their class (see near_duplicates()), with all their columns, whatever their names.

    Of rows that repeat both id and text one stays. Texts without words, null ones among them, are one class. An empty
    table stays empty.
    """
    repeated = not docs.groupBy(id_col).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    kept = near_duplicates(docs, id_col=id_col, text_col=text_col, sha=repeated).filter("kept")
    if repeated:  # rows of one id may differ in text, so a row is known by both
        return kept_rows(docs, kept.select("doc_id", "sha"), id_col, F.coalesce(F.col(text_col), F.lit("")))
    keep_id = fresh(docs, "_keep_id")
    kept = materialize(kept.select(F.col("doc_id").alias(keep_id)), "kept")
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(keep_id)), "left_semi")
