"""Byte-level BPE: exact encoding by backtracking, decoding by an offset table.

Encoding.  A text is cut into pieces by the pattern of the vocabulary.  For each piece an
Aho-Corasick automaton over the reversed tokens gives the longest token that starts at
each byte.  The encoder walks left to right with those longest tokens; a token may follow
another only if the pair-compatibility test (would the merges, applied in order, ever join
something across the border?) accepts it, else it tries the next shorter prefix token or
takes the last token back.  Bytes that turned out to be dead ends are marked, so each is
visited a bounded number of times and the result is the one that the merge rules give.

Decoding.  All token bytes lie in one buffer; an offset table gives each token's slice, and
numpy gathers the bytes of a whole document at once.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the
empty string; repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_rows, table

#: Pieces and pair verdicts kept per Python worker; when full they are dropped, not refused.
CACHE_PIECES = 150_000
CACHE_PAIRS = 200_000
#: The split pattern of the byte-level vocabulary.
#: White space as the tokenizer's pattern library sees it (Unicode White_Space).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins by which the vocabulary file spells bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Pieces(dict):
    def __init__(self, codec: ByteBPE):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.encode_piece(piece.encode())
        if len(piece) <= 64:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class ByteBPE:
    def __init__(self, spec: bytes):
        import ahocorasick

        doc = json.loads(spec)
        alphabet = _byte_alphabet()
        spell = lambda s: bytes(alphabet[c] for c in s)
        vocab = doc["model"]["vocab"]
        # Inside, a token is numbered by its merge: bytes first, then merges in order.
        base = sorted((spell(t), i) for t, i in vocab.items() if len(t) == 1)
        self.token = [t for t, _ in base]
        self.vocab_id = [i for _, i in base]
        number = {t: n for n, t in enumerate(self.token)}
        self.left, self.right = list(range(len(base))), list(range(len(base)))
        self.joined: dict[int, int] = {}
        for merge in doc["model"]["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = number[spell(a)], number[spell(b)]
            whole = self.token[x] + self.token[y]
            if whole not in number:
                number[whole] = len(self.token)
                self.token.append(whole)
                self.vocab_id.append(vocab[a + b])
                self.left.append(x)
                self.right.append(y)
            self.joined.setdefault(x << 32 | y, number[whole])
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in self.token]
        self.size = [len(t) for t in self.token]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for t, n in number.items():
            self.machine.add_word(t[::-1].decode("latin-1"), n)
        self.machine.make_automaton()
        self.as_u32 = np.array(self.vocab_id, "<u4")
        self.special = {x["content"]: x["id"] for x in doc.get("added_tokens", [])}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = regex.compile(SPLIT)
        self.pairs: dict[int, bool] = {}
        self.pieces = _Pieces(self)
        # The offset table: token i of the file is buffer[start[i] : start[i] + length[i]].
        spelled = dict(zip(self.vocab_id, self.token, strict=True)) | {i: s.encode() for s, i in self.special.items()}
        self.length = np.zeros(max(spelled) + 1, np.int64)
        for i, t in spelled.items():
            self.length[i] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.buffer = np.frombuffer(b"".join(spelled[i] for i in sorted(spelled)), np.uint8)
        self.decimal = [str(i) for i in range(len(self.length))]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between token a and a following token b.

        Undo the later of the two merges again and again; if at some depth the tokens at
        the border would have been joined before the undone merge took place, they would
        not stand side by side in the end.
        """
        known = self.pairs.get(key := a << 32 | b)
        if known is not None:
            return known
        joined, bound, fine = self.joined, 1 << 40, True
        x, y = a, b
        while True:
            whole = joined.get(x << 32 | y)
            if whole is not None and whole < bound:
                fine = False
                break
            inner_x, inner_y = self.right[x], self.left[y]
            if x > y and inner_x != x:
                bound, x = x, inner_x
            elif inner_y != y:
                bound, y = y + 1, inner_y
            elif inner_x != x:
                bound, x = x, inner_x
            else:
                break
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = fine
        return fine

    def encode_piece(self, piece: bytes) -> bytes:
        """Ids of one piece, as little-endian unsigned 32-bit integers."""
        n = len(piece)
        longest = [-1] * n
        for end, tok in self.machine.iter(piece[::-1].decode("latin-1")):
            if longest[at := n - 1 - end] < 0:
                longest[at] = tok  # the automaton reports the longest match of a place first
        size, shorter, compatible = self.size, self.shorter, self.compatible
        out: list[int] = []
        dead = bytearray(n + 1)
        at, tok = 0, longest[0] if n else -1
        while at < n:
            last = out[-1] if out else -1
            while tok >= 0 and (dead[at + size[tok]] or last >= 0 and not compatible(last, tok)):
                tok = shorter[tok]
            if tok >= 0:
                out.append(tok)
                at += size[tok]
                if at < n:
                    tok = longest[at]
            else:
                dead[at] = 1
                tok = out.pop()
                at -= size[tok]
                tok = shorter[tok]
        return self.as_u32[out].tobytes()

    def encode(self, text: str) -> np.ndarray:
        find, get = self.split.findall, self.pieces.__getitem__
        if self.special_split and any(s in text for s in self.special):
            parts = [np.array([self.special[x]], "<u4").tobytes() if i % 2 else b"".join(map(get, find(x))) for i, x in enumerate(self.special_split.split(text))]
            return np.frombuffer(b"".join(parts), "<u4")
        return np.frombuffer(b"".join(map(get, find(text))), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        length = self.length[ids]
        ends = np.cumsum(length)
        shift = np.repeat(self.start[ids] - (ends - length), length)
        return self.buffer[shift + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> str:
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _codec(spec: bytes) -> ByteBPE:
    return ByteBPE(spec)


def _read(path: str | None) -> bytes:
    with open(path or default_vocabulary(), "rb") as f:
        return f.read()


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) for each row.  The vocabulary file is read by the driver and
    broadcast (its size is fixed, about 1.5 MB)."""
    spec = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def work(chunk):
        codec = _codec(spec.value)
        return [chunk.column(0), [codec.encode(t or "").astype(np.int32) for t in chunk.column(1).to_pylist()]]

    return map_rows(docs, [id_col, text_col], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>", work)


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """(id_col, text) for each row of ids; null ids decode to the empty string."""
    spec = encoded.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def work(chunk):
        codec = _codec(spec.value)
        return [chunk.column(0), [codec.decode(np.array(x or [], np.int64)) for x in chunk.column(1).to_pylist()]]

    return map_rows(encoded, [id_col, ids_col], f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string", work)


def bpe_round_trip(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The kept columns, n_tokens, digests of the ids and of the text decoded from them, and,
    if asked for, the ids.  Else these go no further than the worker: what leaves it is 150
    bytes a document."""
    spec = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def work(chunk):
        codec = _codec(spec.value)
        n, ids_sha, text_sha, all_ids = [], [], [], []
        for t in chunk.column(len(keep)).to_pylist():
            ids = codec.encode(t or "")
            n.append(len(ids))
            ids_sha.append(hashlib.sha256(codec.listed(ids).encode()).hexdigest())
            text_sha.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            all_ids.append(ids.astype(np.int32))
        return [*(chunk.column(i) for i in range(len(keep))), n, ids_sha, text_sha, *([all_ids] if with_ids else [])]

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_rows(docs, [*keep, text_col], f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, work)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), ["doc_id"])
