"""Token counts at every prefix of a text, by dynamic programming over byte-pair tokens.

The last token of a prefix's encoding is the one vocabulary entry that ends the prefix and is
*compatible* with the last token of the prefix before it: the pair, encoded alone, stays as it
is. So count[i] = count[i - len(last)] + 1, for every byte position, in one pass and without
encoding any prefix again. Texts are cut where a space follows a non-space, which no
pre-token crosses; each distinct chunk is worked out once and kept in a bounded table.

Null texts count as empty and give zero tokens. Empty tables give empty results. Repeated rows
are answered one by one, and columns other than the named ones are never looked at. Special
strings inside a text become their special token, as the tokenizer's defaults have it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Chunks that a worker keeps; the table starts afresh beyond it.
KEPT_CHUNKS = 800_000
#: Pairs of tokens whose compatibility a worker keeps.
KEPT_PAIRS = 2_000_000
_PRE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
# separators of ASCII that Python calls spaces and the tokenizer doesn't stay inside a chunk
_CHUNK = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")
_SLOW = re.compile(r"\s |\s\Z|[\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Counts for one byte-level vocabulary file (``tokenizers`` JSON without a normalizer)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level vocabulary without normalizer or prefix space is needed")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.ids = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # a merged token's id grows with its rank, bytes come before all of them
        self.merged: dict[int, int] = {}
        self.halves = {i: (i, i) for i in self.bytes_of}
        for pair in spec["model"]["merges"]:
            a, b = (as_bytes(x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            whole = self.ids[a + b]
            self.merged[self.ids[a] << 20 | self.ids[b]] = whole
            self.halves[whole] = (self.ids[a], self.ids[b])
        ranks = list(self.merged.values())
        if ranks != sorted(ranks) or any(len(self.bytes_of[i]) == 1 and i > ranks[0] for i in self.bytes_of):
            raise ValueError("token ids have to follow the ranks of their merges")
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[bytes, int] = {}
        self.totals: dict[str, int] = {}

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives the two tokens again.

        The merges that made the tokens are undone from the youngest on. Where the tokens that
        face each other at the seam have a merge older than what was undone last, that merge
        would have come first, and the tokens would not have formed.
        """
        merged, halves = self.merged, self.halves
        before = 1 << 30
        while True:
            whole = merged.get(a << 20 | b)
            if whole is not None and whole < before:
                return False
            left, right = halves[a][1], halves[b][0]
            # undo the younger of the two; on a tie the left one merged first
            if a > b and left != a or right == b:
                if left == a:
                    return True
                before, a = a, left
            else:
                before, b = b + 1, right

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._stay_apart(a, b)
        return known

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of piece[:i] for i = 0 .. len, where the piece is one pre-token."""
        n, get, pairs, longest = len(piece), self.ids.get, self.pairs, self.longest
        counts, last = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for k in range(i - longest if i > longest else 0, i):
                token = get(piece[k:i])
                if token is None:
                    continue
                if k:
                    known = pairs.get(last[k] << 20 | token)
                    if not (self.compatible(last[k], token) if known is None else known):
                        continue
                counts[i], last[i] = counts[k] + 1, token
                break
        return counts

    def piece_total(self, piece: bytes) -> int:
        """The last of a pre-token's counts, kept."""
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= KEPT_CHUNKS:
                self.pieces.clear()
            known = self.pieces[piece] = self.piece_counts(piece)[-1]
        return known

    def chunk_total(self, chunk: str) -> int:
        """The last of a chunk's counts: its pre-tokens' last counts together."""
        if self.special and self.special.search(chunk):
            return self.chunk_counts(chunk)[-1]
        return sum(self.piece_total(m.encode()) for m in _PRE.findall(chunk))

    def _plain_counts(self, text: str) -> list[int]:
        out = [0]
        for m in _PRE.finditer(text):
            piece = m.group()
            own = self.piece_counts(piece.encode())
            if len(piece) == 3 and piece[0] == "'" and piece in ("'re", "'ve", "'ll"):
                own[2] = 2  # cut short, it is a quote and a letter
            base = out[-1]
            out.extend(base + c for c in own[1:])
        # a cut inside leading spaces leaves them all to one pre-token
        lead = len(text) - len(text.lstrip())
        if lead > 1 and lead < len(text):
            spaces = text[:lead].encode()
            out[: len(spaces) + 1] = self.piece_counts(spaces)
        return out

    def chunk_counts(self, chunk: str) -> list[int]:
        """Tokens of every byte prefix of a chunk (spaces, then non-spaces)."""
        if not self.special or not self.special.search(chunk):
            return self._plain_counts(chunk)
        out, at = [0], 0
        for m in self.special.finditer(chunk):
            base = out[-1]
            # up to the special string's last byte the text before runs on into its letters
            run = self._plain_counts(chunk[at : m.end()])
            out.extend(base + c for c in run[1:])
            before = self._plain_counts(chunk[at : m.start()])[-1]
            out[-1] = base + before + 1
            at = m.end()
        base = out[-1]
        out.extend(base + c for c in self._plain_counts(chunk[at:])[1:])
        return out

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of every byte prefix of a text."""
        out = [0]
        for chunk in _CHUNK.findall(text):
            base = out[-1]
            out.extend(base + c for c in self.chunk_counts(chunk)[1:])
        return out

    def _total(self, chunk: str) -> int:
        known = self.totals.get(chunk)
        if known is None:
            if len(self.totals) >= KEPT_CHUNKS:
                self.totals.clear()
            known = self.totals[chunk] = self.chunk_total(chunk)
        return known

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix counts, from its chunks' last entries."""
        if not text:
            return 0
        if _SLOW.search(text):
            return sum(map(self._total, _CHUNK.findall(text)))
        head, *parts = text.split(" ")
        first = sum(map(self._total, _CHUNK.findall(head)))
        totals = self.spaced
        try:
            return first + sum(map(totals.__getitem__, parts))
        except KeyError:
            for part in set(parts).difference(totals):
                if len(totals) >= KEPT_CHUNKS:
                    totals.clear()
                totals[part] = sum(map(self.chunk_total, _CHUNK.findall(" " + part)))
            return first + sum(totals[p] if p in totals else self.total(" " + p) for p in parts)

    @property
    def spaced(self) -> dict[str, int]:
        """Totals of a space and what follows it up to the next, kept under the latter."""
        return self.__dict__.setdefault("_spaced", {})

    def cut(self, text: str, budget: int) -> tuple[int, int]:
        """(bytes, tokens) of the longest prefix, at a character's end, of at most ``budget`` tokens."""
        raw, counts = text.encode(), self.prefix_counts(text)
        ends = (k for k in range(len(raw), -1, -1) if (k == len(raw) or raw[k] & 0xC0 != 0x80) and counts[k] <= budget)
        k = next(ends)
        return k, counts[k]


_LOADED: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process, with what it has learned from earlier tasks."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    id_field = docs.schema["doc_id"]
    schema = T.StructType([id_field, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            sizes, tokens = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                sizes.append(len(text.encode()))
                tokens.append(c.total(text))
            n = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([t > limit for t in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, counts): tokens of every byte prefix, as an array of length bytes + 1."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("counts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: the arrays are several times the text
                counts = c.prefix_counts(batch.column(1)[k].as_py() or "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([counts], pa.list_(pa.int32()))], names=["doc_id", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def truncate(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """(doc_id, text, n_tokens): each text's longest prefix of at most ``budget`` tokens."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in batches:
            texts, tokens = [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                size, n = c.cut(text, budget)
                texts.append(text.encode()[:size].decode())
                tokens.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(tokens, pa.int64())], names=["doc_id", "text", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
