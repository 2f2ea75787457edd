"""BPE encoding and decoding, exact and in linear time.

Encoding: text is cut at added tokens and by the pre-tokenizer's pattern; each piece goes
through a backtracking encoder. An Aho-Corasick pass finds the longest token from each
position; a token may follow another only if the two are compatible, which means that
merging by rank would not have joined anything across their border. Where none fits, the
encoder falls back to the next shorter token and marks dead positions, so that no position
is tried twice. Decoding gathers bytes through an offset table.

Defined results: a null text is empty: no ids, and the digest of no bytes; repeated rows
give repeated rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tessera.llm.common import give_back, pick, small_batches

#: White space by Unicode's property, spelled out, since the libraries' shorthand classes differ.
SPACE = "\\t\\n\\x0b\\x0c\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's pattern (fixed value, with the class above for white space).
_SHAPE = "'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{S}{NOT}]+|[{S}]+(?![^{S}])|[{S}]+"


def _pieces(letters: str, numbers: str, rest: str) -> regex.Pattern:
    return regex.compile(_SHAPE.replace("{L}", letters).replace("{N}", numbers).replace("{NOT}", rest).replace("{S}", SPACE), regex.V1)


PIECES = _pieces(r"\p{L}", r"\p{N}", r"\p{L}\p{N}")
#: Code points that became letters or numbers after the Unicode version which the tokenizers library knows (fixed values).
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    r"\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    r"\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER = regex.compile(f"[{LATER}]")


@cache
def _strict_pieces() -> regex.Pattern:
    """For texts with such code points: to the library they are neither letter nor number."""
    return _pieces(rf"[\p{{L}}--[{LATER}]]", rf"[\p{{N}}--[{LATER}]]", rf"[[\p{{L}}\p{{N}}]--[{LATER}]]")


def pieces(text: str) -> list[str]:
    return (_strict_pieces() if not text.isascii() and _LATER.search(text) else PIECES).findall(text)


#: Pieces whose ids a worker keeps in each of two generations, and pairs of tokens it keeps. They bound memory, never results.
CACHE, FITS = 250_000, 250_000


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        size = max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.added.items():
            self.bytes[i] = content.encode()
        self.split_added = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

        ids = {self.bytes[i]: i for i in vocab.values()}
        # rank of a token: the order in which merging makes it; single bytes come first, in order of id
        made = [vocab[a + b] for a, b in merges]
        singles = sorted(set(vocab.values()) - set(made))
        order = singles + made
        self.rank = [size] * size
        for r, i in enumerate(order):
            self.rank[i] = r
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in merges:
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            if whole not in self.halves:
                self.halves[whole] = (left, right)
            self.joined.setdefault((left, right), whole)
        # the next shorter token that begins a token
        self.shorter = [-1] * size
        for b, i in ids.items():
            for n in range(len(b) - 1, 0, -1):
                if (j := ids.get(b[:n])) is not None:
                    self.shorter[i] = j
                    break
        # Aho-Corasick over bytes written as Latin-1
        self.automaton = ahocorasick.Automaton()
        for b, i in ids.items():
            self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.ids = ids
        self.fit: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        lengths = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.table = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two apart when they stand side by side."""
        known = self.fit.get((left, right))
        if known is None:
            if len(self.fit) >= FITS:
                self.fit.clear()
            known = self.fit[left, right] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        """Undo both sides step by step, the later merge first: a pair at the border that would have merged before
        the merges undone so far shows that the two cannot stand."""
        bound = 1 << 60
        while True:
            whole = self.joined.get((left, right))
            if whole is not None and self.rank[whole] < bound:
                return False
            a, b = self.rank[left], self.rank[right]
            if a > b and left in self.halves:
                bound, left = a, self.halves[left][1]
            elif right in self.halves:
                # on equal ranks the left one merges first, so that a pair of the same rank as the right counts too
                bound, right = b + 1, self.halves[right][0]
            elif left in self.halves:
                bound, left = a, self.halves[left][1]
            else:
                return True

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.ids.get(piece)
        if whole is not None and self._stands(whole):
            return (whole,)
        longest: list[int] = [-1] * len(piece)
        best = [0] * len(piece)
        for end, (token, n) in self.automaton.iter(piece.decode("latin-1")):
            start = end - n + 1
            if n > best[start]:
                best[start], longest[start] = n, token
        out: list[int] = []
        dead = bytearray(len(piece) + 1)
        at, token = 0, longest[0]
        while True:
            end = at + len(self.bytes[token])
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == len(piece):
                    return tuple(out)
                token = longest[at]
                continue
            token = self.shorter[token]
            while token < 0:
                # nothing fits here: the position is dead, and the token before it must be shorter
                dead[at] = 1
                token = out.pop()
                at -= len(self.bytes[token])
                token = self.shorter[token]

    def _stands(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in the token (every token that merges make does)."""
        return token in self.halves or len(self.bytes[token]) == 1

    def encode(self, text: str) -> np.ndarray:
        out: list[bytes] = []
        parts = self.split_added.split(text) if self.split_added is not None and any(x in text for x in self.added) else (text,)
        known = self.cache
        for part in parts:
            if part in self.added:
                out.append(self.added[part].to_bytes(4, "little"))
                continue
            for piece in pieces(part):
                ids = known.get(piece)
                if ids is None:
                    ids = self.older.get(piece)
                    if ids is None:
                        ids = array("I", self.encode_piece(piece.encode())).tobytes()
                    if len(piece) <= 64:
                        if len(known) >= CACHE:
                            self.older, self.cache = known, {}
                            known = self.cache
                        known[piece] = ids
                out.append(ids)
        return np.frombuffer(b"".join(out), dtype="<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Token bytes side by side, gathered from one table by its offsets."""
        start = self.offsets[ids]
        length = self.offsets[ids.astype(np.int64) + 1] - start
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        step = np.ones(total, dtype=np.int64)
        if total:
            full = length > 0
            start, length, ends = start[full], length[full], ends[full]
            step[0] = start[0]
            step[ends[:-1]] = start[1:] - (start[:-1] + length[:-1] - 1)
        return self.table[np.cumsum(step)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and on request the ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, digests, decoded, ids_out, text_out = [], [], [], [], []
                for text in part.column(1):
                    ids = bpe.encode(text.as_py() or "")
                    back = bpe.decode(ids)
                    n.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    decoded.append(hashlib.sha256(back.encode()).hexdigest())
                    if with_ids:
                        ids_out.append(ids.astype(np.int32))
                        text_out.append(back)
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    more = ", ids array<int>, decoded string" if with_ids else ""
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
