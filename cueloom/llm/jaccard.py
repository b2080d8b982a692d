"""Exact Jaccard join of documents on word shingles with a token-group matrix.

Two documents link when the Jaccard similarity of their sets of shingles reaches 3/4 (or another
``share``); the result is every document's component.  No pairs of a group are listed:

1. Documents with the same set are one set from here on.
2. A set can only link if enough of its shingles occur in other sets.  Of each set's shingles in hash
   order the first quarter and some more are counted (``shared_counts``); two linked sets share at
   least ``extra`` of those, so a set with fewer shared ones links with nothing and is done.
3. The sets left are partitioned into groups: blocks of sets with the same least shingle, under each of
   three hash orders, cut into chunks, are linked exactly inside the chunk; then only chunk roots
   meet, until a block fits one chunk.  Components of these links are the groups.
4. The token-group matrix says which groups hold a shingle (the union of their sets).  Shingles are
   ordered by the number of groups that hold them.  A set Q meets a group that is not its own only if
   a rare shingle of Q is a rare shingle of a smaller set of the group (prefix filter on both sides);
   the overlap of Q with the group's union then bounds the similarity with any member, and only
   groups whose bound reaches the threshold are opened: Q is compared with their members.
5. Components of groups and links.

Steps 2 to 5 lose no link: each filter is a necessary condition.  Shingles and sets are known by
64-bit hashes.

Defined cases: null and empty texts, and texts of white space, have an empty set and link with
nothing; fewer words than a shingle make one shingle; repeated rows each get a row and equal sets
always share a component; rows with a null id link only through equal sets and a component without any id
has a null ``component_id``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from cueloom.llm.components import components
from cueloom.llm.hashing import mix, window_hashes, word_hashes
from cueloom.shared import pin, ship

CHUNK = 1000  # sets compared with each other in one task
FEW = 8  # sets of a block up to which all pairs are counted, many blocks together
PART = 500_000  # shingles of a group, or of the sets that ask for it, held at once
BLOCKS = 3  # hash orders whose least shingle makes a block
_SEEDS = mix(np.arange(1, BLOCKS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BATCH_KEYS = 500_000  # pairs a worker sorts at once, some 100 bytes each
_MANY = np.uint32(0xFFFFFFFF)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``k`` words, A-Z lowered; a shorter text is one run."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = word_hashes(words)
    if len(words) < k:
        return mix(window_hashes(hashed, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(hashed, k))


def fingerprint(tokens: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(tokens.tobytes()) - (1 << 63)


def least_hashes(tokens: np.ndarray) -> list[int]:
    """The least shingle under each of BLOCKS hash orders, the first being the shingles' own."""
    if not len(tokens):
        return []
    seeds = [np.uint64(0), *_SEEDS]
    return [int((mix(tokens ^ seed) if seed else tokens).min().view(np.int64)) ^ n for n, seed in enumerate(seeds)]


def need(n: int, num: int, den: int) -> int:
    """Least overlap of a set of ``n`` with any set it links with: ceil(n * num / den)."""
    return -(-n * num // den)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, digest, n, sid): size and fingerprint of each document's set; null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t, k) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), pa.array([len(m) for m in made], pa.int64()),
                pa.array([fingerprint(m) if len(m) else None for m in made], pa.int64()),
            ], ["doc_id", "digest", "n", "sid"])

    return docs.mapInArrow(run, "doc_id bigint, digest bigint, n bigint, sid bigint")


def _runs(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted tokens: number of the run each belongs to, and the runs' lengths."""
    new = np.concatenate([[True], tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, bool)
    run = np.cumsum(new) - 1
    return run, np.bincount(run) if len(run) else np.empty(0, np.int64)


def shared_counts(docs: DataFrame, keys_of: Callable[[str], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """(sid, shared): how many keys of an owner other owners hold too.

    ``keys_of`` gives the owners (int64) and keys (uint64) of a text, pair by pair.  Pairs travel packed
    by bucket of the key.  Each task counts what it sees shared by itself and sends such a key once,
    without owners: a key that a third of the owners hold arrives once per task.  Counts may be too
    high for owners that occur in several tasks, never too low.
    """

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sids, owners = np.unique(np.concatenate([o for o, _ in held]), return_inverse=True)
        keys = np.concatenate([k for _, k in held])
        order = np.lexsort((owners, keys))
        keys, owners = keys[order], owners[order].astype(np.uint32)
        single = np.concatenate([[True], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
        keys, owners = keys[single], owners[single]
        run, length = _runs(keys)
        twice = length[run] > 1
        local = np.bincount(owners[twice], minlength=len(sids))
        keep = ~twice | np.concatenate([[True], run[1:] != run[:-1]])
        keys, owners = keys[keep], np.where(twice, _MANY, owners)[keep]
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        keys, owners, bucket = keys[order], owners[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = []
        for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist():
            o = owners[ends[b] : ends[b + 1]]
            known = o != _MANY
            own, number = np.unique(o[known], return_inverse=True)
            o = o.copy()
            o[known] = number
            rows.append((b, keys[ends[b] : ends[b + 1]].tobytes(), o.astype("<u4").tobytes(), sids[own].tobytes()))
        counted = np.flatnonzero(local)
        rows.append((
            buckets + int(sids[0]) % buckets, b"", local[counted].astype("<u4").tobytes(), sids[counted].tobytes()
        ))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["bucket", "keys", "owners", "sids"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                own = keys_of(text)
                if len(own[0]):
                    held.append(own)
                    size += len(own[0])
                if size > _BATCH_KEYS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def second(parts):
        if parts["bucket"].iloc[0] >= buckets:
            sids = np.concatenate([np.frombuffer(s, np.int64) for s in parts["sids"]])
            return by_owner(sids, np.concatenate([np.frombuffer(o, "<u4") for o in parts["owners"]]))
        keys, owners, base, every = [], [], 0, []
        for k, o, s in zip(parts["keys"], parts["owners"], parts["sids"], strict=True):
            sids, own = np.frombuffer(s, np.int64), np.frombuffer(o, "<u4").astype(np.int64)
            keys.append(np.frombuffer(k, np.uint64))
            owners.append(np.where(own == int(_MANY), -1, own + base))
            every.append(sids)
            base += len(sids)
        names, number = np.unique(np.concatenate(every), return_inverse=True)
        key, owner = np.concatenate(keys), np.concatenate(owners)
        owner = np.where(owner < 0, -1, number[owner] if len(number) else -1)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        single = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
        key, owner = key[single], owner[single]
        run, length = _runs(key)
        many = length + 2 * np.bincount(run, owner < 0, len(length)).astype(np.int64)
        counts = np.bincount(owner[(many[run] > 1) & (owner >= 0)], minlength=len(names))
        some = np.flatnonzero(counts)
        return by_owner(names[some], counts[some])

    def by_owner(sids: np.ndarray, counts: np.ndarray):
        """Counts of one bucket, packed by bucket of their owners."""
        home = sids % buckets
        order = np.argsort(home, kind="stable")
        sids, counts, home = sids[order], counts[order].astype("<u4"), home[order]
        ends = np.searchsorted(home, np.arange(buckets + 1))
        rows = [
            (b, sids[ends[b] : ends[b + 1]].tobytes(), counts[ends[b] : ends[b + 1]].tobytes())
            for b in np.flatnonzero(ends[1:] > ends[:-1]).tolist()
        ]
        return pd.DataFrame(rows, columns=["home", "sids", "counts"])

    def third(parts):
        sids = np.concatenate([np.frombuffer(s, np.int64) for s in parts["sids"]])
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in parts["counts"]])
        names, number = np.unique(sids, return_inverse=True)
        return pd.DataFrame({"sid": names, "shared": np.bincount(number, counts).astype(np.int64)})

    packed = docs.select("text").mapInArrow(first, "bucket int, keys binary, owners binary, sids binary")
    counted = packed.groupBy("bucket").applyInPandas(second, "home int, sids binary, counts binary")
    return counted.groupBy("home").applyInPandas(third, "sid bigint, shared bigint")


def _prefix_keys(k: int, num: int, den: int) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """Step 2's shingles of a set: the first in hash order, a quarter and a seventh."""

    def keys(text: str) -> tuple[np.ndarray, np.ndarray]:
        made = shingles(text, k)
        n = len(made)
        if not n:
            return np.empty(0, np.int64), made
        own = made[: n - need(n, num, den) + max(1, n // 7)]
        return np.full(len(own), fingerprint(made)), own

    return keys


def link_chunk(ids: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Roots (least id) of the components that links among these sets make, by an inverted index.

    A search starts at each set not yet reached and compares only with sets not reached.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    sorted_tokens, posting = tokens[order], owners[order]
    number, length = _runs(sorted_tokens)
    start = np.concatenate([[0], np.cumsum(length)])
    at = np.empty(len(tokens), np.int64)
    at[order] = number
    ends = np.cumsum(sizes)
    root, left = np.full(len(sets), -1), np.ones(len(sets), bool)
    for seed in np.argsort(ids, kind="stable"):
        if root[seed] >= 0:
            continue
        root[seed], left[seed], front = seed, False, [seed]
        while front and left.any():
            x = front.pop()
            mine = at[ends[x] - sizes[x] : ends[x]]
            mine = mine[length[mine] > 1]
            many = length[mine]
            held = np.repeat(start[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
            met = np.bincount(posting[held], minlength=len(sets))
            linked = np.flatnonzero(left & (met > 0) & (den * met >= num * (sizes + sizes[x] - met)))
            root[linked], left[linked] = seed, False
            front += linked.tolist()
    return ids[root]


def link_few(counts: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the sets that link, for blocks of ``counts`` sets, FEW at most, one after the other."""
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(tokens, kind="stable")
    # Owners of one token are in order, so those of one block stand together.
    tokens, owners = tokens[order], owners[order]
    block = np.repeat(np.arange(len(counts)), counts)[owners]
    met = np.zeros(len(sets) * FEW, np.int64)
    for step in range(1, int(counts.max())):
        both = np.flatnonzero((tokens[step:] == tokens[:-step]) & (block[step:] == block[:-step]))
        a, b = owners[both], owners[both + step]
        met += np.bincount(a * FEW + b - a, minlength=len(met))
    pair = np.flatnonzero(met)
    a, met = pair // FEW, met[pair]
    b = a + pair % FEW
    linked = den * met >= num * (sizes[a] + sizes[b] - met)
    return a[linked], b[linked]


def block_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links inside the blocks of ``sets`` (sid, block, tokens), as set and root.

    A task takes many small blocks.  A block of more than CHUNK sets is cut into chunks; then only the
    chunks' roots go on, until a block fits one chunk or its roots no longer get fewer.  Links between
    chunks that no root shows are not found here: ``all_links`` and ``jaccard_components`` add them.
    """
    slots = 4 * int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(rows):
        rows = rows.sort_values(["block", "chunk", "sid"], kind="stable")
        block, chunk, ids = (rows[c].to_numpy() for c in ("block", "chunk", "sid"))
        new = np.concatenate([[True], (block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1]), [True]])
        edge, root = np.flatnonzero(new), ids.copy()
        tokens, large, counts = rows["tokens"].to_numpy(), rows["large"].to_numpy(), np.diff(edge)
        few = (counts > 1) & (counts <= FEW) & ~large[edge[:-1]]
        for low, high in zip(edge[:-1][~few], edge[1:][~few], strict=True):
            if high - low > 1:
                root[low:high] = link_chunk(ids[low:high], [np.frombuffer(t, np.uint64) for t in tokens[low:high]], num, den)
        keep = (root != ids) | large
        found = [pd.DataFrame({"block": block[keep], "a": ids[keep], "b": root[keep]})]
        if few.any():
            mine = np.flatnonzero(np.repeat(few, counts))
            a, b = link_few(counts[few], [np.frombuffer(t, np.uint64) for t in tokens[mine]], num, den)
            found.append(pd.DataFrame({"block": block[mine[a]], "a": ids[mine[b]], "b": ids[mine[a]]}))
        return pd.concat(found)

    left, links, before = sets, None, None
    while True:
        counted = left.groupBy("block").agg(F.count("*").alias("sets")).filter(F.col("sets") > CHUNK)
        large = pin(counted.select("block", F.ceil(F.col("sets") / CHUNK).alias("chunks")), "large")
        cut = left.join(large, "block", "left").withColumns({
            "large": F.col("chunks").isNotNull(), "chunk": F.coalesce(F.pmod(F.xxhash64("sid"), "chunks"), F.lit(0)),
        })
        slot = F.pmod(F.xxhash64("block", "chunk"), F.lit(slots)).alias("slot")
        made = pin(
            cut.select("sid", "block", "chunk", "large", "tokens", slot).groupBy("slot")
            .applyInPandas(run, "block bigint, a bigint, b bigint"), "links"
        )
        links = made if links is None else links.union(made)
        state = large.agg(F.count("*"), F.sum("chunks")).first()
        if not state[0] or state == before:
            return links.filter("a <> b").select("a", "b").distinct()
        before = state
        roots = made.filter("a = b").select("block", F.col("a").alias("sid"))
        left = sets.join(large.select("block"), "block", "left_semi").join(roots, ["block", "sid"], "left_semi")


def _unpacked(sets: DataFrame, *keep: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                own = [np.frombuffer(t, np.int64) for t in part.column("tokens").to_pylist()]
                row = np.repeat(np.arange(part.num_rows), [len(o) for o in own])
                if len(row):
                    taken = part.select(list(keep)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(own))], [*keep, "token"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sets.select(*keep).schema.fields)
    return sets.select(*keep, "tokens").mapInArrow(run, f"{kind}, token bigint")


def _across_groups(sets: DataFrame, groups: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links between sets (sid, n, tokens) of different groups (sid, grp), one or more for every two
    groups that have any.  An asking set is sent once to each part of a group it meets, a group being cut into
    parts of about PART shingles; no pairs of sets are listed."""
    rows = _unpacked(sets.join(groups, "sid"), "sid", "n", "grp").repartition("token")
    matrix = rows.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    held = matrix.groupBy("token").agg(F.count("*").alias("groups")).filter("groups > 1")
    common = pin(rows.join(held, "token").select("sid", "n", "grp", "token", "groups"), "matrix")
    # Rare first; shingles that only the own group holds stand before all of these.
    listed = common.groupBy("sid", "n", "grp").agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).alias("own"))
    alone = F.col("n") - F.size("own")
    reach = lambda top, bottom: F.col("n") - F.ceil(F.col("n") * top / bottom) + 1 - alone
    cut = listed.select(
        "sid", "n", "grp", F.size("own").alias("common"),
        F.slice("own", F.lit(1), F.greatest(F.lit(0), F.least(F.size("own"), reach(num, den).cast("int")))).alias("probe"),
        F.slice("own", F.lit(1), F.greatest(F.lit(0), F.least(F.size("own"), reach(2 * num, num + den).cast("int")))).alias("index"),
    )
    cut = pin(cut.filter("size(probe) > 0"), "prefix")
    probe = cut.select(F.col("sid").alias("q"), F.col("n").alias("nq"), F.col("grp").alias("gq"), F.explode("probe.token").alias("token"))
    index = cut.select("sid", "n", "grp", F.explode("index.token").alias("token"))
    rare = index.groupBy("token", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    met = probe.join(rare, "token").filter(
        (F.col("gq") != F.col("grp")) & (F.col("least") <= F.col("nq")) & (F.col("most") * den >= F.col("nq") * num)
    ).select("q", "nq", "gq", "grp").distinct()
    met = pin(met, "candidates")
    weight = sets.select("sid", "n").join(groups, "sid").groupBy("grp").agg(F.sum("n").alias("weight"))
    parts = met.groupBy("grp").agg(F.sum("nq").alias("asked")).join(weight, "grp").select(
        "grp", F.ceil(F.col("asked") / PART).alias("asks"), F.ceil(F.col("weight") / PART).alias("holds")
    )
    parts = pin(parts, "parts")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    ask = met.join(parts, "grp").select(
        "grp", every("holds").alias("hold"), F.pmod(F.xxhash64("q"), "asks").alias("ask"), F.col("q").alias("sid"), "gq"
    ).join(sets.select("sid", "tokens"), "sid")
    hold = groups.join(parts, "grp").select(
        "grp", F.pmod(F.xxhash64("sid"), "holds").alias("hold"), every("asks").alias("ask"), "sid", F.col("grp").alias("gq")
    ).join(sets.select("sid", "tokens"), "sid")
    key = ["grp", "hold", "ask"]
    dealt = ask.unionByName(hold).repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, found = None, [], []
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in key])
            edge = [0, *(np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edge[:-1], edge[1:], strict=True):
                if low == high:
                    continue
                if part and now != names[:, low].tolist():
                    found += _open(pa.Table.from_batches(part), num, den)
                    part = []
                now = names[:, low].tolist()
                part.append(batch.slice(low, high - low))
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], ["a", "b"])
            found = []
        if part:
            found = _open(pa.Table.from_batches(part), num, den)
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _open(part: pa.Table, num: int, den: int) -> list[tuple[int, int]]:
    """Links (query, least member) between members of a group (gq = grp) and sets of others that ask for it,
    one for each group of the askers.  The union of the members' shingles bounds an asker's similarity with any
    of them; the members are opened to those within the bound only."""
    sids, own = part.column("sid").to_numpy(), part.column("gq").to_numpy()
    member = own == part.column("grp").to_numpy()
    tokens = [np.frombuffer(t, np.uint64) for t in part.column("tokens").to_pylist()]
    members, askers = np.flatnonzero(member), np.flatnonzero(~member)
    if not len(members) or not len(askers):
        return []
    members = members[np.argsort(sids[members], kind="stable")]
    sizes = np.array([len(tokens[m]) for m in members], np.int64)
    flat = np.concatenate([tokens[m] for m in members])
    order = np.argsort(flat, kind="stable")
    posting = np.repeat(np.arange(len(members)), sizes)[order]
    union, start = np.unique(flat[order], return_index=True)
    start = np.append(start, len(flat))
    links, linked = [], set()
    for q in askers.tolist():
        n, group = len(tokens[q]), int(own[q])
        if group in linked:
            continue
        at = np.searchsorted(union, tokens[q])
        at = at[union[np.minimum(at, len(union) - 1)] == tokens[q]]
        if den * len(at) < num * n:
            continue
        met = np.bincount(np.concatenate([posting[start[t] : start[t + 1]] for t in at.tolist()]), minlength=len(members))
        hit = np.flatnonzero(den * met >= num * (sizes + n - met))
        if len(hit):
            linked.add(group)
            links.append((int(sids[q]), int(sids[members[hit[0]]])))
    return links


def all_links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that make every component of the blocks of ``sets`` (sid, block, tokens), whatever
    the size of a block; sets of blocks over CHUNK are compared across their groups by an exact join."""
    links = block_links(sets, num, den)
    large = sets.groupBy("block").agg(F.count("*").alias("sets")).filter(F.col("sets") > CHUNK).select("block")
    large = pin(large, "large")
    if large.isEmpty():
        return links
    links = pin(links, "links")
    own = sets.join(large, "block", "left_semi").dropDuplicates(["sid"])
    own = pin(own.select("sid", F.expr("length(tokens) div 8").alias("n"), "tokens"), "tokens")
    groups = components(links).select(F.col("node").alias("sid"), F.col("root").alias("grp"))
    of = pin(own.select("sid").join(groups, "sid", "left").select("sid", F.coalesce("grp", "sid").alias("grp")), "groups")
    return links.union(_across_groups(own, of, num, den))


def jaccard_components(
    docs: DataFrame, k: int = 5, share: tuple[int, int] = (3, 4), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, digest (of the text), n_shingles, component (its name, null for the
    empty set), component_id (least id of its component)."""
    spark = docs.sparkSession
    ship(spark)
    num, den = share
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = own.withColumn("digest", F.xxhash64("text"))
    sets = pin(_sets(own, k), "sets")
    known = sets.filter("sid IS NOT NULL").groupBy("sid", "n").agg(F.min("doc_id").alias("rep"))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_counts(own, _prefix_keys(k, num, den), buckets)
    # The smallest partner has need(n) shingles, so it asks for no more than this.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / den) / 7))
    left = pin(known.join(shared, "sid").filter(F.col("shared") >= least).select("sid", "rep"), "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sids = batch.column("text").to_pylist(), batch.column("sid").to_pylist()
            made = [shingles(t, k) for t in texts]
            right = [bool(len(m)) and fingerprint(m) == s for m, s in zip(made, sids, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column("sid"), pa.array([len(m) for m in made], pa.int64()),
                pa.array([least_hashes(m) for m in made], pa.list_(pa.int64())),
                pa.array([m.tobytes() for m in made], pa.binary()),
            ], ["sid", "n", "blocks", "tokens"]).filter(pa.array(right, pa.bool_()))

    texts = own.join(left.select(F.col("rep").alias("doc_id"), "sid").hint("merge"), "doc_id").select("sid", "text")
    held = pin(texts.mapInArrow(packed, "sid bigint, n bigint, blocks array<bigint>, tokens binary").dropDuplicates(["sid"]), "tokens")
    blocks = held.select("sid", F.explode("blocks").alias("block"), "tokens")
    groups = components(block_links(blocks, num, den)).select(F.col("node").alias("sid"), F.col("root").alias("grp"))
    of = pin(held.select("sid").join(groups, "sid", "left").select("sid", F.coalesce("grp", "sid").alias("grp")), "groups")
    links = pin(_across_groups(held, of, num, den), "across")
    between = links.join(of.select(F.col("sid").alias("a"), F.col("grp").alias("ga")), "a").join(
        of.select(F.col("sid").alias("b"), F.col("grp").alias("gb")), "b"
    )
    merged = components(between.select(F.col("ga").alias("a"), F.col("gb").alias("b")))
    final = of.join(merged.select(F.col("node").alias("grp"), "root"), "grp", "left").select(
        "sid", F.coalesce("root", "grp").alias("root")
    )
    named = known.join(final, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = named.join(least_id, "root").select("sid", "root", "component_id")
    lone = F.when(F.col("sid").isNull(), F.col("doc_id"))
    return sets.join(answer, "sid", "left").select(
        "doc_id", "digest", F.col("n").alias("n_shingles"), F.col("root").alias("component"),
        F.coalesce(lone, "component_id").alias("component_id"),
    )


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component of ``found``: the one of least id, then of least text hash;
    documents with a null id come last, documents with an empty set all stay."""
    stands = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    chosen = found.filter("component IS NOT NULL").groupBy("component").agg(F.min(stands).alias("own")).select("own.doc_id", "own.digest")
    empty = found.filter("component IS NULL").select("doc_id", "digest").distinct()
    keep = chosen.withColumn("single", F.lit(True)).union(empty.withColumn("single", F.lit(False))).hint("merge")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.xxhash64(F.col(text_col).cast("string")).alias("seen"))
    met = rows.join(keep, F.col(f"own.`{id_col}`").cast("long").eqNullSafe(keep["doc_id"]) & (F.col("seen") == keep["digest"]))
    copies = Window.partitionBy(keep["doc_id"], "digest").orderBy("single")
    return met.withColumn("copy", F.row_number().over(copies)).filter("copy = 1 OR NOT single").select("own.*")
