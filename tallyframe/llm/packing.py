"""Best-fit packing by a linear grouping scheme.

Only the counts of each length, of which there are at most ``capacity``, go to the driver.
There the large lengths are sorted into groups of equal cardinality and rounded up to each
group's largest, configurations of these few sizes are chosen by a knapsack over what is
left, the actual documents take the rounded ones' places, and the small lengths go best-fit
into what remains. Where large begins and how many groups there are is tried out on the counts,
and the plan with the fewest sequences stays. The plan is a table of lots: ranks a .. b of a length fill sequences from
s on. Documents get their rank among equals of a length in Spark and look up their lot, so
neither plan nor broadcast grows with the number of documents.

Null texts are packed as empty ones. Repeated rows are packed once each. An empty table gives
no sequences.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import gapless_rank, materialize

CAPACITY = 4096
END_ID = 1
#: Tried out: (lengths up to this part of the capacity are small, groups).
SCHEMES = ((1 / 8, 64), (1 / 4, 128), (1 / 3, 200), (1 / 2, 300))
#: Chunks of text whose ids a worker keeps.
KEPT_CHUNKS = 1_000_000
_LOADED: dict[str, ChunkEncoder] = {}


class KnownChunks(dict):
    """Ids of chunks; a chunk that isn't there is encoded and kept. The table starts afresh beyond ``KEPT_CHUNKS``."""

    def __init__(self, encode: Callable[[bytes], bytes]):
        self.encode = encode

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= KEPT_CHUNKS:
            self.clear()
        ids = self[chunk] = self.encode(chunk)
        return ids


class ChunkEncoder:
    """Ids of texts, 4 little-endian bytes each, by way of the distinct chunks between spaces.

    No token of this kind of vocabulary crosses a space, so a chunk has the same ids wherever it
    stands. The vocabulary lower-cases, so A-Z are lowered first; a full stop or comma after a
    letter at a chunk's end is a chunk of its own, as it is a token of its own. Texts with a
    special string are left as they are: special strings are told apart by case. So are texts in
    which a combining mark may follow one of A-Z: the vocabulary composes before it lowers, and
    t and a diaeresis have a composed form where T and a diaeresis have none.

    Chunks of printable ASCII, letters of Latin-1 and Latin Extended-A and Cyrillic are normal already
    once they are lowered, and are parted here as the vocabulary parts them; the merges alone
    are asked of the tokenizer's model. Other chunks go through the whole tokenizer.
    """

    _END = re.compile(rb"[.,](?<=[a-z].)(?=[\x20\x09-\x0D]|\Z)")
    _MARKED = re.compile(rb"[A-Z](?!\xe2\x80|[\xe4-\xe9])[\xcc-\xff]")  # U+0300 and beyond, but for quotes, dashes and U+4000 to U+9FFF
    _SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    _LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f"
    _PLAIN = re.compile(f"[!-~{_LETTERS}]+")
    _PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        steps = json.dumps(spec["normalizer"])
        split = json.dumps(spec["pre_tokenizer"])
        if '"Lowercase"' not in steps or '"Removed"' not in split or "[^\\\\s\\\\p{L}\\\\p{N}]+" not in split:
            raise ValueError("a lower-casing vocabulary that drops white space and parts letters from signs is needed")
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in spec["added_tokens"]) or rb"(?!)")
        self.known = KnownChunks(self._ids)
        self.model = self.tokenizer.model if self._parts_alike(spec) else None
        self.letters = {b: c for b, c in enumerate(_byte_letters()) if chr(b) != c}

    def _parts_alike(self, spec: dict) -> bool:
        """Whether normalizer and splitting are those that ``_PLAIN`` and ``_PARTS`` stand for."""
        steps = spec["normalizer"].get("normalizers", [])
        split, *letters = spec["pre_tokenizer"].get("pretokenizers", [{}])
        return (
            [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and split == {"type": "Split", "pattern": {"Regex": self._SPLIT}, "behavior": "Removed", "invert": True}
            and [(x["type"], x["add_prefix_space"], x["use_regex"]) for x in letters] == [("ByteLevel", False, False)]
            and spec["model"]["type"] == "BPE" and spec["model"]["dropout"] is None
        )

    def chunks(self, text: str | None) -> list[bytes]:
        raw = (text or "").encode()
        lower = raw.lower()
        if self.special.search(raw) or self.special.search(lower) or (not raw.isascii() and self._MARKED.search(raw)):
            return raw.split()
        return self._END.sub(rb" \g<0>", lower).split()

    def _ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        low = text.lower()
        if self.model is None or not self._PLAIN.fullmatch(low) or self.special.search(chunk):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            spelled = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in self._PARTS.findall(low)]
            ids = [t.id for x in spelled for t in self.model.tokenize(x)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            yield b"".join(map(self.known.__getitem__, self.chunks(text)))


def _byte_letters() -> list[str]:
    """The letter for each byte in a byte-level vocabulary: visible ones stand for themselves, others follow from U+0100."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in seen else next(rest)) for b in range(256)]


def encoder(path: str) -> ChunkEncoder:
    """One a worker process, with what it has learned from earlier tasks."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only beyond ``capacity``."""
    long = T.LongType()
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", long),
        T.StructField("length", long), T.StructField("ids_crc32", long),
    ])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for k, ids in enumerate(encoder(path).encode(batch.column(1).to_pylist())):
                ids += end
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, group of each place): the largest size left, and the fullest company for it."""
    counts, out = list(counts), []
    while any(counts):
        first = next(g for g, c in enumerate(counts) if c)
        best: dict[int, tuple[int, ...]] = {0: ()}
        room = capacity - sizes[first]
        for g in range(first, len(sizes)):
            have = counts[g] - (g == first)
            for _ in range(min(have, room // sizes[g])):
                new = {used + sizes[g]: (*places, g) for used, places in best.items() if used + sizes[g] <= room and used + sizes[g] not in best}
                if not new:
                    break
                best |= new
        places = [first, *best[max(best)]]
        times = min(counts[g] // places.count(g) for g in set(places))
        for g in places:
            counts[g] -= times
        out.append((times, places))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, small: int = 512, n_groups: int = 64) -> list[tuple[int, int, int, int, int, int]]:
    """Lots (length, first rank, end rank, first sequence, offset, documents of it a sequence)."""
    lots: list[tuple[int, int, int, int, int, int]] = []
    left: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free room: (first sequence, sequences)
    used = dict.fromkeys(counts, 0)
    n_sequences = 0
    large = sorted((n for n in counts if n > small), reverse=True)
    total = sum(counts[n] for n in large)
    groups: list[deque[list[int]]] = []  # each: [length, documents]
    if total:
        share, room = -(-total // n_groups), 0
        for n in large:
            c = counts[n]
            while c:
                if not room:
                    groups.append(deque())
                    room = share
                take = min(c, room)
                groups[-1].append([n, take])
                c, room = c - take, room - take
    sizes, cards = [g[0][0] for g in groups], [sum(c for _, c in g) for g in groups]
    for times, places in _configurations(sizes, cards, capacity):
        while times:
            # a stretch of sequences in which every place holds documents of one length
            heads, need = [], {}
            for g in places:
                need[g] = need.get(g, 0) + 1
            run = min(times, *(max(1, groups[g][0][1] // need[g]) for g in need))
            at = 0
            if run == 1:
                for g in places:
                    n = groups[g][0][0]
                    heads.append(n)
                    groups[g][0][1] -= 1
                    if not groups[g][0][1]:
                        groups[g].popleft()
            else:
                for g in places:
                    heads.append(groups[g][0][0])
                    groups[g][0][1] -= run
                for g in need:
                    if not groups[g][0][1]:
                        groups[g].popleft()
            for n in heads:
                lots.append((n, used[n], used[n] + run, n_sequences, at, 1))
                used[n] += run
                at += n
            left[capacity - at].append((n_sequences, run))
            n_sequences += run
            times -= run
    for n in sorted((n for n in counts if n <= small), reverse=True):
        c, room = counts[n], n
        while c:
            while room <= capacity and not left[room]:
                room += 1
            if room > capacity:
                fresh = -(-c // (capacity // n))
                left[capacity].append((n_sequences, fresh))
                n_sequences += fresh
                room = capacity
            first, many = left[room].pop()
            each = min(room // n, c)
            take = min(many, c // each)
            if take < many:
                left[room].append((first + take, many - take))
            lots.append((n, used[n], used[n] + take * each, first, capacity - room, each))
            used[n] += take * each
            c -= take * each
            left[room - each * n].append((first, take))
    return lots


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """The plan of fewest sequences over ``SCHEMES``; of equal ones the first."""
    plans = [plan(counts, capacity, int(capacity * small), n_groups) for small, n_groups in SCHEMES]
    return min(plans, key=lambda lots: max((s - (a - b) // each for _, a, b, s, _, each in lots), default=0))


LOT = "length long, first long, last long, sequence long, at long, each long"


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (length, and columns that tell rows apart) with sequence_id and offset."""
    spark, columns = parts.sparkSession, parts.columns
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    lots = spark.createDataFrame(best_plan(counts, capacity), LOT)
    ranked = gapless_rank(parts, ["length"], [c for c in columns if c != "length"], "__rank")
    r = F.col("__rank")
    placed = ranked.join(F.broadcast(lots), (ranked["length"] == lots["length"]) & (r >= lots["first"]) & (r < lots["last"]))
    k = r - F.col("first")
    return placed.select(
        *[ranked[c] for c in columns],
        (F.col("sequence") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("each")) * lots["length"]).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(materialize(pieces(docs, path, capacity), "pieces"), capacity)
