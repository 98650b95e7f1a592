"""SimHash near-duplicates: fingerprints of word shingles, linked by a self-join of binary tries under a Hamming budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haetae.llm.common import add_columns, cut_lineage
from haetae.llm.components import components

#: Words of a shingle, seed of the hash, and differing bits up to which fingerprints link.
SHINGLE, SEED, BUDGET = 4, 42, 4
#: Node pairs that the traversal holds at once, and fingerprints above which a group is dealt out further.
FRONTIER, GROUP = 1 << 17, 100_000
#: Ids of rows to be dropped that are broadcast at most: some tens of MB.
DROPPED = 1_000_000
_U1 = np.uint64(1)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if over half of the shingles' hashes have it; 0 without words."""
    import xxhash

    words = text.lower().split()  # bytes: lower-cases A-Z, splits at space, tab, LF, VT, FF, CR
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.array([len(w) for w in words], np.int64) + 1) - 1
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip([0, *(ends[: len(words) - k] + 1).tolist()], ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def _fingerprints() -> Callable[[pa.Array], dict[str, Any]]:
    return lambda texts: {"fp": np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)}


def _find(parent: np.ndarray) -> np.ndarray:
    """Root of each node of a forest."""
    while not np.array_equal(parent, up := parent[parent]):
        parent = up
    return parent


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest member) after linking a[i] with b[i]."""
    while True:
        x, y = label[a], label[b]
        if not len(differ := np.flatnonzero(x != y)):
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        label = _find(parent)[label]


def trie_components(keys: np.ndarray, fixed: np.ndarray, budget: int = BUDGET, frontier: int = FRONTIER) -> np.ndarray:
    """Label (position of the smallest member) of each of the distinct sorted ``keys`` under links of ``budget`` or fewer differing bits.

    The sorted keys are a binary trie: a node is a range of keys with a common prefix. Pairs of nodes of one
    depth are traversed together from (root, root) on: their children are paired, a bit in which the two differ
    is one error, and a pair with over ``budget`` errors is pruned. Bits of ``fixed`` must agree. Pairs of two
    single keys are decided at once. Budgets 1, 2, ... are tried in turn, and a pair both of whose nodes lie
    wholly in one and the same component already is pruned too: thousands of keys close to each other then cost
    about as much as they are many, not their square. Pending pairs are a stack of chunks, so memory stays bounded.
    """
    n = len(keys)
    label = np.arange(n)
    for errors in range(1, budget + 1):
        change = np.zeros(n, np.int64)
        stack = [(63, *(np.array([x]) for x in (0, n, 0, n, 0)))] if n > 1 else []
        np.cumsum(label[1:] != label[:-1], out=change[1:])
        while stack:
            bit, alo, ahi, blo, bhi, e = stack.pop()
            done = (change[ahi - 1] == change[alo]) & (change[bhi - 1] == change[blo]) & (label[alo] == label[blo])
            if done.any():
                alo, ahi, blo, bhi, e = (x[~done] for x in (alo, ahi, blo, bhi, e))
            single = (ahi - alo == 1) & (bhi - blo == 1)
            if single.any():
                a, b = alo[single], blo[single]
                differ = keys[a] ^ keys[b]
                near = (np.bitwise_count(differ) <= errors) & (differ & fixed == 0)
                if near.any():
                    label = _unite(label, a[near], b[near])
                    np.cumsum(label[1:] != label[:-1], out=change[1:])
                alo, ahi, blo, bhi, e = (x[~single] for x in (alo, ahi, blo, bhi, e))
            if not len(alo):
                continue
            if len(alo) > frontier:
                half = len(alo) // 2
                stack += [(bit, alo[:half], ahi[:half], blo[:half], bhi[:half], e[:half]), (bit, alo[half:], ahi[half:], blo[half:], bhi[half:], e[half:])]
                continue
            mask = _U1 << np.uint64(bit)
            amid, bmid = (np.searchsorted(keys, ((keys[lo] >> np.uint64(bit)) | _U1) << np.uint64(bit)) for lo in (alo, blo))
            amid, bmid = np.clip(amid, alo, ahi), np.clip(bmid, blo, bhi)
            self_pair, out = alo == blo, []
            for x, y, more, keep in (((alo, amid), (blo, bmid), 0, None), ((amid, ahi), (bmid, bhi), 0, None), ((alo, amid), (bmid, bhi), 1, None), ((amid, ahi), (blo, bmid), 1, ~self_pair)):
                ok = (x[0] < x[1]) & (y[0] < y[1]) & (e + more <= errors)
                if more and fixed & mask:
                    continue
                if keep is not None:
                    ok &= keep
                out.append((x[0][ok], x[1][ok], y[0][ok], y[1][ok], e[ok] + more))
            alo, ahi, blo, bhi, e = (np.concatenate(x) for x in zip(*out))
            lone = (ahi - alo == 1) & (bhi - blo == 1) & (alo == blo)
            if lone.any():
                alo, ahi, blo, bhi, e = (x[~lone] for x in (alo, ahi, blo, bhi, e))
            if len(alo):
                stack.append((bit - 1, alo, ahi, blo, bhi, e))
    return label


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks that deal ``bits`` to ``parts`` blocks."""
    return [sum(1 << b for b in bits[i * len(bits) // parts : (i + 1) * len(bits) // parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(prints: DataFrame, masks: dict[int, list[int]] | None, budget: int) -> DataFrame:
    """``prints`` (fp, and mask where ``masks`` tells the finer ones of each) by mask and value of its bits."""
    pair = lambda m: F.struct(F.lit(_signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
    if masks is None:
        return prints.select("fp", F.explode(F.array(*[pair(m) for m in _blocks(list(range(64)), budget + 1)])).alias("k")).select("fp", "k.*")
    finer: Any = None
    for m, more in masks.items():
        made = F.array(*[pair(x) for x in more])
        finer = F.when(F.col("mask") == _signed(m), made) if finer is None else finer.when(F.col("mask") == _signed(m), made)
    return prints.select("fp", F.explode(finer).alias("k")).select("fp", "k.*")


def links(prints: DataFrame, budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints ``fp`` that links of ``budget`` or fewer bits connect.

    Of ``budget`` + 1 blocks of bits two linked fingerprints agree in one at least, so each fingerprint goes to
    a group for each block's value, and groups are joined with themselves by ``trie_components``, many in one trie. A group of over
    ``group`` fingerprints is dealt out by blocks of its other bits, again without losing a link, and so on until
    no group is larger. It ends: fingerprints that agree in all but ``budget`` bits are 2**``budget`` at most. A
    group returns a tree for each of its components, fewer edges than it has fingerprints, never all pairs.
    """
    parts, dealt, group = [], _dealt(prints, None, budget), max(group, 1 << budget)
    while True:
        hot = cut_lineage(dealt.groupBy("mask", "value").count().filter(F.col("count") > group).select("mask", "value"))
        found = [r["mask"] & (1 << 64) - 1 for r in hot.select("mask").distinct().collect()]  # masks, not groups: 5 at first
        if not found:
            parts.append(dealt)
            break
        parts.append(dealt.join(hot, ["mask", "value"], "left_anti"))
        masks = {m: [m | x for x in _blocks([b for b in range(64) if not m >> b & 1], budget + 1)] for m in found}
        dealt = cut_lineage(_dealt(dealt.join(hot, ["mask", "value"], "left_semi"), masks, budget).distinct())
    dealt = parts[0]
    for part in parts[1:]:
        dealt = dealt.unionByName(part)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for mask, value, fp in _whole_groups(batches):
            for m in np.unique(mask):
                mine = mask == m
                yield pa.RecordBatch.from_pydict(dict(zip("ab", _forest(fp[mine].view(np.uint64), int(m) & (1 << 64) - 1, budget))))

    return dealt.repartition("mask", "value").sortWithinPartitions("mask", "value").mapInArrow(join, "a long, b long")


def _whole_groups(batches: Iterator[pa.RecordBatch], at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted rows (mask, value, fp) in lots of about ``at_once``, each group in one lot."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        held = [np.concatenate([old, new.to_numpy()]) for old, new in zip(held, (batch["mask"], batch["value"], batch["fp"]))]
        if len(held[0]) >= at_once:
            last = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(last):
                yield tuple(x[: last[-1] + 1] for x in held)
                held = [x[last[-1] + 1 :] for x in held]
    if len(held[0]):
        yield tuple(held)


def _forest(prints: np.ndarray, mask: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree for each component among fingerprints that agree in the bits of ``mask``.

    The bits of ``mask`` go to the top of the keys, so that all groups of a mask are one trie, in which no error is
    allowed above the groups' own roots.
    """
    order = [b for b in range(64) if mask >> b & 1][::-1] + [b for b in range(64) if not mask >> b & 1][::-1]
    prints = np.unique(prints)
    keys = np.zeros(len(prints), np.uint64)
    for to, b in enumerate(order):
        keys |= (prints >> np.uint64(b) & _U1) << np.uint64(63 - to)
    sort = np.argsort(keys)
    prints, keys, n = prints[sort], keys[sort], mask.bit_count()
    label = trie_components(keys, np.uint64(((1 << n) - 1) << (64 - n)), budget)
    child = np.flatnonzero(label != np.arange(len(keys)))
    return prints[child].view(np.int64), prints[label[child]].view(np.int64)


def _clusters(prints: DataFrame, budget: int, group: int) -> DataFrame:
    """(fp, root, component_id) for each fingerprint: its component's root, and the smallest doc_id of the component.

    Only linked fingerprints are grouped by root. Their smallest ids are materialised before they are joined back,
    so that the join of a large component's fingerprints can be split.
    """
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = each.join(components(links(each.select("fp"), budget, group)).withColumnRenamed("node", "fp"), "fp")
    smallest = cut_lineage(linked.groupBy("root").agg(F.min("least").alias("component_id")))
    found = each.join(linked.select("fp", "root").join(smallest, "root"), "fp", "left")
    return found.select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, group: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (the smallest doc_id reachable by links) of every row.

    Texts that are null, empty or without words have fingerprint 0 and link like any other. Rows with a null id
    take part, but don't count for component_id, which is null where no member has an id. Repeated rows come
    back as often as they are there. Other columns are not read; an empty table gives no rows.
    """
    prints = cut_lineage(add_columns(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", "fp long", _fingerprints, ["doc_id"]))
    found = prints.join(_clusters(prints, budget, group), "fp")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, group: int = GROUP, at_once: int = DROPPED) -> DataFrame:
    """The rows of ``docs``, all columns, with the smallest id of each component of near-duplicates.

    Of rows that repeat that id (or are all without an id) one stays. Fingerprints are worked out once and kept with
    the ids; which ids go is decided there. Up to ``at_once`` of these are broadcast, so that texts stay where they
    are; more are joined by a shuffle. Only rows whose id isn't theirs alone are looked at again by their text.
    """
    prefix = "__own_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    row_id, keys = F.col(f"`{id_col}`"), [f"{prefix}id", f"{prefix}none"]
    named = lambda frame, c: frame.withColumns({keys[0]: F.coalesce(c.cast("string"), F.lit("")), keys[1]: c.isNull()})
    prints = cut_lineage(add_columns(docs.select(row_id.alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", "fp long", _fingerprints, ["doc_id"]))
    chosen = prints.join(_clusters(prints, budget, group), "fp").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = cut_lineage(named(chosen.groupBy("root").agg(F.min(F.struct("fp", "doc_id")).alias("one")), F.col("one.doc_id")).select(*keys, F.col("one.fp").alias(f"{prefix}fp")))
    ids = named(prints, F.col("doc_id")).groupBy(*keys).agg((F.count("*") > 1).alias("many"))
    goes = cut_lineage(ids.join(chosen.select(*keys, F.lit(True).alias("stays")), keys, "left").filter("many or stays is null").select(*keys, "many").distinct())
    size, repeated = goes.agg(F.count("*"), F.coalesce(F.bool_or("many"), F.lit(False))).first()
    near = lambda frame: F.broadcast(frame) if size <= at_once else frame
    rows = named(docs, row_id)
    kept = rows.join(near(goes.select(*keys)), keys, "left_anti")
    if repeated:
        again = add_columns(rows.join(near(goes.filter("many").select(*keys)), keys, "left_semi"), text_col, f"{prefix}fp long", lambda: _renamed(prefix))
        again = again.join(chosen, [*keys, f"{prefix}fp"], "left_semi").dropDuplicates([*keys, f"{prefix}fp"])
        kept = kept.unionByName(again.drop(f"{prefix}fp"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _renamed(prefix: str) -> Callable[[pa.Array], dict[str, Any]]:
    kernel = _fingerprints()
    return lambda texts: {f"{prefix}fp": kernel(texts)["fp"]}
