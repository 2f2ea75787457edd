"""URL filter: a bit-parallel wildcard automaton over canonical URLs.

Every rule, whether (host, path) or a glob, becomes one pattern of a multiword Shift-And
automaton; all patterns are simulated at once, one byte position of a batch of URLs at a
time. `*` positions are self-loops of the automaton.

Defined results: a null url or one without `://` has an empty host and path, fits no rule
and gets the default verdict; repeated rows are judged alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import pick

#: (verdict, host, path prefix): a rule fits its host, all subdomains, and paths that start so.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: (verdict, glob over host and path): asked only where no host rule fits; the longest that fits wins.
GLOBS = (
    ("block", "*cheap-pills*"),
    ("block", "*casino*"),
    ("block", "*poker*"),
    ("block", "*viagra*"),
    ("block", "*porn*"),
    ("block", "*/wp-login*"),
    ("block", "*.exe"),
    ("block", "*.zip"),
    ("allow", "*.edu/*"),
    ("allow", "*.gov/*"),
)
#: Bytes that UTF-8 never has: before the canonical URL's host, between host and path, and at the end.
HEAD, SPLIT, TAIL = 0xFD, 0xFE, 0xFF
STAR = -1


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host.translate(_LOWER), rest[:end]


_LOWER = {c: c + 32 for c in range(65, 91)}


def rule_pattern(host: str, path: str) -> list[int]:
    """`.host` at the end of the dotted host, then the path's beginning."""
    return [HEAD, STAR, *f".{host}".encode(), SPLIT, *path.encode(), STAR, TAIL]


def glob_pattern(glob: str) -> list[list[int]]:
    """A glob over host + path. The split byte stands before a `/`, at the end, or inside a star: a pattern for each."""
    out = [[c for c in glob]] if "*" in glob else []
    for at in range(len(glob) + 1):
        if (at == len(glob) or glob[at] == "/") and glob[max(at - 1, 0) : at] != "*":
            out.append([*glob[:at], SPLIT, *glob[at:]])
    flat = []
    for parts in out:
        row = [HEAD, ord(".")]
        for c in parts:
            row += [c] if isinstance(c, int) else [STAR] if c == "*" else list(c.encode())
        flat.append([*row, TAIL])
    return flat


@dataclass
class ShiftAnd:
    """Patterns packed into words of 64 states; a state is one symbol, and a star is a loop on the state before it."""

    masks: np.ndarray  # (256, words): states entered by a byte
    loops: np.ndarray  # (words,): states that stay on any byte but HEAD
    starts: np.ndarray
    ends: list[tuple[int, int]]  # (word, bit) of each pattern's last state

    @classmethod
    def of(cls, patterns: Sequence[Sequence[int]]) -> ShiftAnd:
        states = sum(sum(c != STAR for c in p) for p in patterns)
        words = max(1, -(-states // 64))
        masks = np.zeros((256, words), dtype=np.uint64)
        loops, starts, ends, at = np.zeros(words, dtype=np.uint64), np.zeros(words, dtype=np.uint64), [], 0
        for p in patterns:
            fresh = True
            for c in p:
                if c == STAR:
                    if fresh:
                        raise ValueError("a pattern starts with its head byte")
                    loops[(at - 1) // 64] |= np.uint64(1 << ((at - 1) % 64))
                    continue
                masks[c, at // 64] |= np.uint64(1 << (at % 64))
                if fresh:
                    starts[at // 64] |= np.uint64(1 << (at % 64))
                fresh = False
                at += 1
            ends.append(((at - 1) // 64, (at - 1) % 64))
        return cls(masks, loops, starts, ends)

    def match(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, patterns) boolean: which patterns match each whole text. Memory: texts x words."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        begin, length = offsets[:-1][order], lengths[order]
        state = np.zeros((len(order), len(self.loops)), dtype=np.uint64)
        one, top = np.uint64(1), np.uint64(63)
        for i in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -i, side="left"))  # texts longer than i
            now = state[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            moved &= ~self.starts
            if i == 0:
                moved |= self.starts
            moved &= self.masks[data[begin[:live] + i]]
            if i:
                moved |= now & self.loops
            state[:live] = moved
        out = np.zeros((len(order), len(self.ends)), dtype=bool)
        for k, (word, bit) in enumerate(self.ends):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & one
        return out


def judge(
    df: DataFrame,
    rules: Sequence[tuple[str, str, str]] = HOST_RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """One row per page: page_id, host, path, rule (null where none fits), verdict, glob_rule (the deciding glob)."""
    rules, globs = list(rules), list(globs)
    patterns, owners = [rule_pattern(h.translate(_LOWER), p) for _, h, p in rules], list(range(len(rules)))
    for g, (_, glob) in enumerate(globs):
        for p in glob_pattern(glob):
            patterns.append(p)
            owners.append(len(rules) + g)
    # of the rules that fit the longest wins; of equal ones the first by text
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i][1] + rules[i][2]), rules[i][1] + rules[i][2]))
    glob_rank = sorted(range(len(globs)), key=lambda i: (-len(globs[i][1]), globs[i][1]))
    names = [h + p for _, h, p in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd.of(patterns)
        owner = np.array(owners)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                split = [canonical(u) for u in part.column(1).to_pylist()]
                raw = [bytes([HEAD]) + f".{h}".encode() + bytes([SPLIT]) + p.encode() + bytes([TAIL]) for h, p in split]
                offsets = np.cumsum([0, *map(len, raw)])
                hit = automaton.match(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets)
                fits = np.zeros((len(raw), len(rules) + len(globs)), dtype=bool)
                for k, o in enumerate(owner):
                    fits[:, o] |= hit[:, k]
                chosen, glob, verdict = [None] * len(raw), [None] * len(raw), [default] * len(raw)
                for row in np.flatnonzero(fits.any(axis=1)):
                    i = next((i for i in rank if fits[row, i]), None)
                    if i is not None:
                        chosen[row], verdict[row] = names[i], rules[i][0]
                        continue
                    g = next(g for g in glob_rank if fits[row, len(rules) + g])
                    glob[row], verdict[row] = globs[g][1], globs[g][0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(chosen, pa.string()), pa.array(verdict, pa.string()), pa.array(glob, pa.string())],
                    ["page_id", "host", "path", "rule", "verdict", "glob_rule"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, page_id=id_col, url=url_col).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, glob_rule string")
