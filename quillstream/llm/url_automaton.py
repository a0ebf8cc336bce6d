"""URL filtering by a bit-parallel wildcard automaton.

Glob rules are packed side by side into the bits of a few 64-bit words: one start bit and one bit for
each character of a pattern.  A step on a character shifts all states by one bit and masks them with
the states that this character enters; states with a `*` behind them also stay.  So every rule is
simulated at once, over one pass of the canonical URL.  Batches of URLs of like length run side by
side in numpy, a row of words for each.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Stands between host and path in a canonical URL; NUL in an URL itself is mapped to another symbol.
SEAM = "\0"
NOT_SEAM = "\ufffd"
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = {c: c + 32 for c in range(65, 91)}


class Rule(NamedTuple):
    """A verdict for a host with all its subdomains, where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        """Over "." + host + SEAM + path; the dot lets the host itself and its subdomains match alike."""
        return f"*.{self.host}{SEAM}{self.path}*"


def url_parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of an URL; both empty if it is null or has no `://`."""
    found = _PARTS.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class GlobAutomaton:
    """All of several globs (`*` any run, `?` any one character) as one bit-parallel automaton."""

    def __init__(self, globs: Sequence[str]):
        starts, loops, accepts, enters = [], [], [], {}
        bit = 0
        for glob in globs:
            starts.append(bit)
            for char in glob:
                if char == "*":
                    loops.append(bit)
                else:
                    bit += 1
                    enters.setdefault(char, []).append(bit)
            accepts.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.alphabet = np.array(sorted(ord(c) for c in enters if c != "?"), dtype=np.uint32)
        anything = self._mask(enters.get("?", []))
        self.enter = np.stack([anything, *(anything | self._mask(enters[chr(c)]) for c in self.alphabet)])
        self.start, self.loop = self._mask(starts), self._mask(loops)
        self.accepts = np.array(accepts)

    def _mask(self, bits: Sequence[int]) -> np.ndarray:
        mask = np.zeros(self.words, dtype=np.uint64)
        for b in bits:
            mask[b // 64] |= np.uint64(1 << b % 64)
        return mask

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        """0 for a character that no pattern names, else its place in the alphabet plus 1."""
        if not len(self.alphabet):
            return np.zeros(len(codes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def match(self, texts: Sequence[str], most_cells: int = 1 << 21) -> np.ndarray:
        """Boolean (texts x globs): which globs fit the whole text."""
        length = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(-length, kind="stable")
        out = np.zeros((len(texts), len(self.accepts)), dtype=bool)
        at = 0
        while at < len(order):
            n = max(1, most_cells // max(1, int(length[order[at]])))
            group = order[at : at + n]
            out[group] = self._run([texts[i] for i in group], length[group])
            at += n
        return out

    def _run(self, texts: list[str], length: np.ndarray) -> np.ndarray:
        classes = self._classes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"))
        offset = np.concatenate([[0], np.cumsum(length)[:-1]])
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for step in range(int(length[0]) if len(length) else 0):
            active = int(np.searchsorted(-length, -step, side="left"))  # texts longer than `step`, the first ones
            now = state[:active]
            shifted = now << one
            shifted[:, 1:] |= now[:, :-1] >> top
            state[:active] = (shifted & self.enter[classes[offset[:active] + step]]) | (now & self.loop)
        return (state[:, self.accepts // 64] >> (self.accepts % 64).astype(np.uint64)) & one > 0


class UrlFilter:
    """Rules over URLs: the longest rule that fits gives the verdict, else the default."""

    def __init__(self, rules: Sequence[Rule], default: str = "allow"):
        self.rules = sorted(rules, key=lambda r: (len(r.text), r.text))
        self.default = default
        self.automaton = GlobAutomaton([r.glob for r in self.rules])

    def judge(self, urls: Sequence[str | None]) -> list[tuple[str, str, str | None, str]]:
        """(host, path, rule, verdict) of each URL."""
        parts = [url_parts(u) for u in urls]
        canonical = [f".{h.replace(SEAM, NOT_SEAM)}{SEAM}{p.replace(SEAM, NOT_SEAM)}" for h, p in parts]
        fits = self.automaton.match(canonical) if self.rules and canonical else np.zeros((len(parts), 1), dtype=bool)
        best = np.where(fits.any(axis=1), fits.shape[1] - 1 - fits[:, ::-1].argmax(axis=1), -1)
        return [(h, p, self.rules[b].text, self.rules[b].verdict) if b >= 0 else (h, p, None, self.default) for (h, p), b in zip(parts, best)]


def filter_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every URL.

    Returns id, host, path, rule, verdict: one row per input row, repeated rows included.  Null URLs and
    those without `://` have empty host and path, no rule and the default verdict.  URLs of any length are
    read whole; of rules with equal text the last one sorted holds.  Other columns are left out.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    judge = UrlFilter(rules, default)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        judged = judge.judge(batch.column("url").to_pylist())
        columns = [pa.array(list(c), pa.string()) for c in zip(*judged)]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=[id_col, "host", "path", "rule", "verdict"])

    chosen = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    return map_arrow(chosen, rows, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
