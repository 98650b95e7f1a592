"""Packing of documents into sequences: a configuration linear program over the histogram of lengths, then best fit."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haetae.llm.common import arrow_texts, cut_lineage, slices

#: Pieces of texts whose ids a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Steps of the linear program at most, and its gap to the bound at which it ends.
STEPS, GAP = 40, 0.05
#: Shares of the program's configurations that are tried until a plan is at the bound.
SHARES = (1.0, 0.3, 0.1, 0.03, 0.01)
#: Characters that neither composition nor Unicode's later versions change, and whose lower case doesn't depend on their neighbours: under U+0300, general punctuation, currency signs.
_STABLE = r"\x00-\u02FF\u2010-\u2027\u2030-\u205E\u20A0-\u20BF"
_UNSTABLE, _SPACE = re.compile(f"[^{_STABLE}]"), re.compile(r"[\t\n\x0B\f\r ]+")
#: Bytes of texts that are encoded together.
AT_ONCE = 4 << 20
_PIECE = "piece int, start long, length long, ids_crc32 long"


def _below(kinds: str) -> str:
    """``_STABLE`` characters of the given general categories, letters or numbers, as the inside of a class."""
    return "".join(re.escape(c) for c in map(chr, range(0x300)) if unicodedata.category(c)[0] in kinds)


class Generations:
    """What is remembered: a table of at most ``most`` results, and the one before it."""

    def __init__(self, most: int) -> None:
        self.most, self.now, self.before = most, {}, {}

    def lack(self, wanted: set) -> list:
        """Those of ``wanted`` that are in neither table; ``now`` has all others after this."""
        new = wanted - self.now.keys()
        if len(self.now) + len(new) > self.most:
            self.now, self.before = {}, self.now
            new = wanted
        known = new & self.before.keys()
        self.now.update(zip(known, map(self.before.__getitem__, known)))
        return list(new - known)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, by a tokenizer that merges the matches of its pattern one by one.

    ``independent`` finds out whether nothing is joined across white space: the normaliser replaces runs of it and works on
    characters, and the pattern matches none. Texts of ``_STABLE`` characters are cut by the tokenizer's own pattern into the pieces
    that it merges; others into the words between white space. What isn't remembered of a batch's pieces goes to the library in
    one call. Any other tokenizer gets whole texts.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.independent = independent(spec)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.words = Generations(REMEMBERED), Generations(REMEMBERED // 4)
        if self.independent:
            parts = json.loads(spec)
            first, *rest = parts["pre_tokenizer"]["pretokenizers"]
            pattern = first["pattern"]["Regex"]
            # Pieces are normalised and cut already: the same merges, with nothing before them but white space.
            self.merges = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}))
            vocabulary, mark = self.tokenizer.get_vocab(), parts["model"].get("end_of_word_suffix") or "\0"
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True
            self.cut = re.compile(pattern.replace(r"\p{L}", _below("L")).replace(r"\p{N}", _below("N")))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn_pieces(self, wanted: set[str]) -> None:
        """Encode pieces side by side: each is one match of the pattern, and its last id alone has the mark of a word's end."""
        new = self.pieces.lack(wanted)
        if not new:
            return
        ids = np.array(self.merges.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) == len(new) and (not len(ids) or ends[-1] == 4 * len(ids)):
            data, at = ids.tobytes(), ends.tolist()
            self.pieces.now.update((p, data[a:b]) for p, a, b in zip(new, [0, *at], at))
        else:  # the library cuts otherwise than expected
            self.pieces.now.update((p, self.whole(p)) for p in new)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.independent:
            return [self.whole(t) for t in texts]
        split: list[tuple[dict, list[str]]] = []
        for t in texts:
            plain = not _UNSTABLE.search(t) and not any(a in t for a in self.added)
            split.append((self.pieces, self.cut.findall(t.lower())) if plain else (self.words, _SPACE.split(t)))
        self.learn_pieces(set().union(*[cut for by, cut in split if by is self.pieces]))
        for w in self.words.lack(set().union(*[cut for by, cut in split if by is self.words])):
            self.words.now[w] = self.whole(w)
        return [b"".join(map(by.now.__getitem__, cut)) for by, cut in split]


def independent(spec: str) -> bool:
    """Whether a tokenizer (its JSON) gives a text the ids of its words between white space, one after the other."""
    t = json.loads(spec)
    steps = (t["normalizer"] or {}).get("normalizers", [t["normalizer"]] if t["normalizer"] else [])
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    splits = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    if not splits or splits[0].get("type") != "Split" or splits[0].get("behavior") != "Removed" or not splits[0].get("invert"):
        return False
    pattern = splits[0]["pattern"].get("Regex", " ")
    blind = pattern.replace("[^\\s\\p{L}\\p{N}]+", "").replace("[\\p{L}]+", "").replace("[\\p{N}]", "")
    plain = not any(c in blind for c in "\\[](){}.*+?^$ ") and pattern.count("[^") == pattern.count("[^\\s\\p{L}\\p{N}]+")
    rest = all(s == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False} for s in splits[1:])
    added = all(not any(c.isspace() for c in a["content"]) and not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not a["normalized"] for a in t["added_tokens"])
    return plain and rest and added and t["post_processor"] is None and all(s == spaces or s["type"] in ("NFC", "Lowercase") for s in steps)


# The plan: counts of lengths only, on the driver.


def price(value: np.ndarray, want: np.ndarray, lengths: np.ndarray, size: int, near: float, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack by dynamic programming: the greatest value in each room, and a length to take first there (0: none, -1: leave one token free).

    Of the lengths whose value is within ``near`` of the best one is drawn by the number of ways to go on from there, each
    way weighted by the product of its lengths' ``want``, so that rare lengths are not asked for more than they are wanted.
    """
    best, ways, take = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, np.int64)
    ways[0] = 1
    share = want / want.sum()
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for room in range(int(lengths[0]), size + 1):
        n = fits[room]
        rest = room - lengths[:n]
        worth = best[rest] + value[:n]
        most = worth.max()
        if most < best[room - 1]:
            best[room], ways[room], take[room] = best[room - 1], ways[room - 1], -1
            continue
        best[room] = most
        way = ways[rest] * share[:n]
        way[worth < most - near] = 0
        way = way.cumsum()
        ways[room] = max(way[-1], 1e-300)
        take[room] = lengths[np.searchsorted(way, draw[room] * way[-1], "right") if way[-1] > 0 else worth.argmax()]
    return best, take


def follow(take: np.ndarray, rooms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths that ``take`` puts into each of ``rooms``: position of the room, length."""
    room, live, where, what = rooms.copy(), np.arange(len(rooms)), [], []
    while len(live):
        step = take[room[live]]
        live, step = live[step != 0], step[step != 0]
        where.append(live[step > 0])
        what.append(step[step > 0])
        room[live] -= np.abs(step)
    return np.concatenate([np.zeros(0, np.int64), *where]), np.concatenate([np.zeros(0, np.int64), *what])


def solve(counts: np.ndarray, size: int, steps: int = STEPS, gap: float = GAP, seed: int = 12) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], float, float]:
    """The configuration linear program by multiplicative weights.

    Least total of configurations (multisets of lengths of at most ``size``) that cover each length ``counts`` times.
    A length's price is its own share of ``size`` at first and falls by a factor for each time that it has been covered;
    each step prices all rooms by the knapsack and adds for each length the best configuration that holds it, as
    much as it is still wanted. Returns the steps' (configuration, length, how much of each configuration), which together cover
    each length once on average; the lower bound by the prices (they are a solution of the dual when the best configuration is
    worth 1), and the total that would cover every length. It ends when these are within ``gap``.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return [], 0.0, 0.0
    rng, demand, at = np.random.default_rng(seed), counts[lengths].astype(float), np.zeros(size + 1, np.int64)
    at[lengths] = np.arange(len(lengths))
    covered, added, total, lower, upper = np.zeros(len(lengths)), [], 0.0, 0.0, np.inf
    while len(added) < steps and upper > (1 + gap) * lower:
        over = covered - covered.min()
        value, want = lengths / size * np.exp(-0.02 * over), demand * np.exp(-over)
        best, take = price(value, want + 1e-300, lengths, size, 0.01, rng.random(size + 1))
        lower = max(lower, float(value @ demand) / best[size])
        hold = np.flatnonzero(value + best[size - lengths] >= 0.98 * best[size])
        room, more = follow(take, size - lengths[hold])
        config, item, much = np.concatenate([np.arange(len(hold)), room]), np.concatenate([hold, at[more]]), want[hold]
        cover = np.bincount(item, much[config], len(lengths)) / demand
        scale = 1 / np.average(cover, weights=demand * lengths)
        covered += scale * cover
        total += scale * float(much.sum())
        added.append((config, lengths[item], scale * much))
        upper = total / covered.min() if covered.min() > 0 else np.inf
    return [(c, l, m / len(added)) for c, l, m in added], lower, upper


def best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Bins by falling length, each into the fullest bin that has room: ((length, how often), ...) and how many bins.

    Equal bins are handled together, so the work grows with the distinct lengths, not with the pieces.
    """
    bins: list[list[tuple[tuple[tuple[int, int], ...], int]]] = [[] for _ in range(size + 1)]  # by room
    rooms = 0  # a bit for each room that a bin has
    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            fit = rooms >> length
            if fit:
                room = length + (fit & -fit).bit_length() - 1
                held, many = bins[room].pop()
                if not bins[room]:
                    rooms &= ~(1 << room)
            else:
                room, held, many = size, (), n
            each = min(room // length, n)
            used = min(many, n // each)
            if used < many and held:
                bins[room].append((held, many - used))
                rooms |= 1 << room
            room -= each * length
            bins[room].append(((*held, (length, each)), used))
            rooms |= 1 << room
            n -= each * used
    return [(tuple(held), many) for group in bins for held, many in group]


def plan(counts: np.ndarray, size: int) -> tuple[list[tuple[tuple[tuple[int, int], ...], int]], float]:
    """Patterns ((length, how often), ...) and how many sequences of each, which together hold ``counts`` exactly; and the lower bound.

    The program's solution is rounded to whole configurations as far as pieces are left, those of the longest piece first: down, and then
    once up for each, so that a long piece finds one of the partners that the program has for it. What is left follows by best fit.
    Patterns are at most a configuration for each length and step, and what best fit makes of the lengths: bounded by
    ``size``, however many pieces there are.
    """
    left = counts.copy()
    full = [(((size, 1),), int(left[size]))] if left[size] else []
    left[size] = 0
    steps, bound, _ = solve(left, size)
    lots = []
    for config, length, much in steps:
        order = np.lexsort((-length, config))
        length, begin = length[order].tolist(), np.searchsorted(config[order], np.arange(len(much) + 1)).tolist()
        lots += [(tuple(length[a:b]), m) for a, b, m in zip(begin, begin[1:], much.tolist())]
    lots.sort(reverse=True)
    best: list = []
    for share in SHARES:
        made = rounded(lots, left, size, share)
        if not best or sum(many for _, many in made) < sum(many for _, many in best):
            best = made
        if sum(many for _, many in best) < bound + 1 - 1e-6:  # no plan has fewer
            break
    return [*full, *best], counts[size] + bound


def rounded(lots: list[tuple[tuple[int, ...], float]], counts: np.ndarray, size: int, share: float, seed: int = 13) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Whole configurations as far as there are pieces, and best fit for what is left: ``share`` of ``lots`` (rising from the least piece) is used."""
    rest, made = counts.tolist(), []
    used = np.random.default_rng(seed).random(len(lots)) < share
    for down in (True, False):
        for (lot, much), use in zip(lots, used.tolist()):
            many = int(much * share) if down else use
            if not many or not rest[lot[0]]:
                continue
            held = tuple(Counter(lot).items())
            many = min(many, min(rest[length] // often for length, often in held))
            if many:
                made.append((held, many))
                for length, often in held:
                    rest[length] -= often * many
    return [*made, *best_fit(np.array(rest, np.int64), size)]


def places(patterns: list[tuple[tuple[tuple[int, int], ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the pieces of each length go: begin of each range (length << 48 | rank among its length), its first sequence and its offset.

    The pieces of a length are taken in the order of their rank; a pattern's sequences are numbered one after the other.
    """
    taken: dict[int, int] = {}
    begins, firsts, offsets, first = [], [], [], 0
    for held, many in patterns:
        offset = 0
        for length, often in held:
            for _ in range(often):
                rank = taken.get(length, 0)
                begins.append(length << 48 | rank)
                firsts.append(first)
                offsets.append(offset)
                taken[length] = rank + many
                offset += length
        first += many
    order = np.argsort(np.array(begins, np.int64), kind="stable")
    return np.array(begins, np.int64)[order], np.array(firsts, np.int64)[order], np.array(offsets, np.int64)[order]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of each piece, ``part`` and ``nth``: the task and the piece's number among those of its length there.

    With ``ids`` also the ids themselves. A null text counts as empty and is one piece, the id ``end`` alone. Texts are encoded whole; only what is
    longer than ``size`` is cut.
    """
    with open(path, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast(file.read())  # a tokenizer's own file: a few MB
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    last = int(end).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(held.value)
        seen, part = np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            row, made, start, length, crc, nth, data = [], [], [], [], [], [], []
            texts = arrow_texts(batch.column(1))
            for a, b in slices(texts, AT_ONCE):
                for i, own_ids in enumerate(encoder.ids(texts.slice(a, b - a).cast(pa.large_string()).to_pylist()), a):
                    all_ids = own_ids + last
                    for at in range(0, len(all_ids), 4 * size):
                        own = all_ids[at : at + 4 * size]
                        n = len(own) // 4
                        row.append(i)
                        made.append(at // (4 * size))
                        start.append(at // 4)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        nth.append(seen[n])
                        seen[n] += 1
                        if ids:
                            data.append(np.frombuffer(own, "<u4").astype(np.int64))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(made, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(data, pa.list_(pa.int64()))] * ids, names=names + ["ids"] * ids)

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, {_PIECE}, part int, nth long" + ", ids array<bigint>" * ids)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end: int = 1, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (with ``ids`` also its ids).

    A document is its ids by the tokenizer at ``path`` without special ones, then the id ``end``; a longer one than ``size``
    is cut into pieces of ``size``, the last of which may be shorter. Sequences hold at most ``size`` ids and are as few
    as the plan finds; within one the offsets are gapless from 0. Null and empty texts are a piece of one id. Null ids, repeated rows
    (each is packed) and other columns (not read) make no difference; an empty table gives no rows.

    Pieces are written to the shared folder once, without their texts. The driver gets the histogram of lengths, ``size``
    numbers at most, and makes the plan from it. Each piece has a rank among those of its length: its number within its
    task and the pieces of tasks before, a running sum over (task, length) counts. So no length, however many rows have it, meets
    in one task, and the plan that is broadcast has a bounded number of ranges of ranks.
    """
    made = cut_lineage(pieces(docs, path, id_col, text_col, size, end, ids))
    counts = made.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    patterns, _ = plan(histogram, size)
    held = docs.sparkSession.sparkContext.broadcast(places(patterns))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = made.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * ids, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, firsts, offsets = held.value
        for batch in batches:
            key = (batch.column("length").to_numpy() << 48) | batch.column("rank").to_numpy()
            at = np.searchsorted(begins, key, "right") - 1
            columns = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(firsts[at] + key - begins[at]), pa.array(offsets[at])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:-1])
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids and offsets of each sequence, from ``pack(..., ids=True)``; a group is one sequence, of bounded size."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"))
