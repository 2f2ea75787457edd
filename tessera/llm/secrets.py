"""Secret scan: pattern spans, and strings that a dictionary-primed compressor finds novel.

Base spans are found by three fixed patterns. The method adds spans of kind `novel`: a
long token in a sensitive context is kept when its marginal compressed size, with zstandard
primed by an identifier dictionary and by the text around it, is close to that of random
bytes. Words, identifiers and repeats of the surroundings compress away. Amid text of its own
alphabet, as in lists of credentials, a random token costs no more than its surroundings do;
there it is kept when it mixes letters and digits as identifiers don't, and the surroundings
hold next to no match for it, literals being charged in full.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows;
an empty table gives an empty result; extra columns are ignored. Spans are in code points,
end exclusive, and are those of whole matches.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from tessera.llm.common import pick

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: Base kinds in their listed order, then the method's own.
KINDS = ("assign", "access", "hex", "novel")
#: Words that make what follows within CONTEXT code points sensitive.
SENSITIVE = re.compile(r"password|passwd|secret|token|api_?key|credential|private_?key|bearer|authorization|access_?key", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
CONTEXT = 64
#: Code points of the surroundings on each side that the compressor sees first; they also set its literal costs.
AROUND = 400
#: Identifier and code fragments that prime the compressor.
DICTIONARY = (
    "password passwd secret token api_key apikey access_key private_key credential bearer authorization basic "
    "import export return function const public static final class void string int float double boolean null none true false "
    "config configuration environment variable example placeholder changeme your_token_here your_api_key_here xxxxxxxx "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1234567890 deadbeef localhost http https www com org net "
    "getElementById addEventListener setTimeout toString valueOf hashCode equals length index value key name type user account service client server request response"
).encode()
#: Marginal compressed bits a byte from which a candidate is incompressible. Random letters of either case and
#: digits cost 7 to 8 amid prose or code, words and identifiers of the surroundings 1 to 5.
NOVEL_BITS = 6.0
#: Share of a candidate that no match in the surroundings may cover, and its joints (see there), at least and a code point,
#: from which it is random whatever its surroundings' alphabet. Identifiers have one or two, random hex or base32 0.3 to 0.5 a code point.
UNMATCHED, JOINTS, JOINTS_EACH = 0.75, 3, 0.12
GRAFT = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: No span of a base kind `assign`, nor a sensitive context, is without one of these (lower-cased bytes).
NEEDLES = (b"passw", b"secret", b"token", b"api", b"credential", b"private", b"bearer", b"authorization", b"access")


class Novelty:
    """Marginal compressed bytes of a string after its context, over the identifier dictionary."""

    def __init__(self, dictionary: bytes = DICTIONARY):
        # a negative level leaves literals as they are
        self.packer, self.matcher = (
            zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False)
            for level in (9, -1)
        )

    def bits(self, context: str, candidate: str) -> float:
        return self.extra(self.packer, context, candidate)

    def unmatched(self, context: str, candidate: str) -> float:
        """Share of the candidate that repeats nothing of the context or the dictionary."""
        return self.extra(self.matcher, context, candidate) / 8.0

    @staticmethod
    def extra(packer: zstandard.ZstdCompressor, context: str, candidate: str) -> float:
        before = context.encode()
        body = candidate.encode()
        extra = len(packer.compress(before + body)) - len(packer.compress(before))
        return 8.0 * extra / len(body)


def joints(word: str) -> float:
    """Places where a letter meets a digit, and half of those where a capital follows a small letter."""
    return len(GRAFT.findall(word)) + len(HUMP.findall(word)) / 2


def sensitive(text: str) -> bool:
    low = text.encode("utf-8", "surrogatepass").lower()
    return any(x in low for x in NEEDLES)


def base_spans(text: str, asked: bool = True) -> list[tuple[int, int, int]]:
    """(start, end, kind index) of the base kinds, in order of start, then kind. asked: it may hold an assignment."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8] if asked else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, threshold: float = NOVEL_BITS) -> list[tuple[int, int, int]]:
    """Incompressible tokens that follow a sensitive word within CONTEXT and overlap no base span. Letters alone, of
    one case or capitalised, are a word: amid few surroundings their cost tells nothing."""
    out, done = [], 0
    starts, ends = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    for m in SENSITIVE.finditer(text):
        near, at = min(m.end() + CONTEXT, len(text)), max(m.end(), done)
        while at < near and (c := CANDIDATE.search(text, at)) and c.start() < near:
            start, end = c.span()
            at = done = end
            word = c[0]
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start or word.isalpha() and (word[1:].islower() or word.isupper()):
                continue
            around = text[max(0, start - AROUND) : start] + "\n" + text[end : end + AROUND] + "\n"
            mixed = joints(word) >= max(JOINTS, JOINTS_EACH * len(word))
            if novelty.bits(around, word) >= threshold or mixed and novelty.unmatched(around, word) >= UNMATCHED:
                out.append((start, end, 3))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVEL_BITS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts, digests, spans = [[], [], [], []], [], []
                for text in part.column(1):
                    text = text.as_py() or ""
                    asked = sensitive(text)
                    base = base_spans(text, asked)
                    more = novel_spans(text, base, novelty, threshold) if asked else []
                    kinds = [k for _, _, k in base]
                    for k in range(3):
                        counts[k].append(kinds.count(k))
                    counts[3].append(len(more))
                    digests.append(hashlib.sha256(shown(base).encode()).hexdigest())
                    spans.append(shown(sorted(base + more, key=lambda s: (s[0], s[2]))))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, pa.int64()) for c in counts[:3]], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")
