"""URL filters: all glob rules run at once over each canonical URL, as bits of one automaton.

A canonical URL is ``.host/path``: ASCII lower-case host, then the path as it is. In a glob ``*``
stands for any run of bytes but ``/`` and ``**`` for any run at all, so that ``*.example.org/en/**``
takes the host, its subdomains and every path below ``/en/``. Each literal byte of each glob is a
state; the states of all globs lie side by side in 64-bit words and one shift, one mask by the
byte at hand and one mask for the wildcards move all of them on (Shift-And).
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64
SLASH = ord("/")


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def glob(self) -> str:
        return f"*.{self.host}{self.path}**"


#: Globs that decide where no rule fits. A host glob is given with and without a path.
BLOCKED_WORDS = ("adult", "bets", "casino", "pills", "porn", "warez")
BLOCKED_GLOBS = tuple(f"*{word}*{rest}" for word in BLOCKED_WORDS for rest in ("", "/**"))


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


class GlobAutomaton:
    def __init__(self, globs: Sequence[str]):
        literals: list[tuple[int, int]] = []
        loops: list[tuple[int, bool]] = []
        self.starts, self.ends, state = [], [], 0
        for glob in globs:
            self.starts.append(state)
            rest = glob.encode()
            while rest:
                if rest[:1] == b"*":
                    loops.append((state, rest[:2] == b"**"))
                    rest = rest.lstrip(b"*")
                else:
                    state += 1
                    literals.append((state, rest[0]))
                    rest = rest[1:]
            self.ends.append(state)
            state += 1
        self.words = max(1, -(-state // WORD))
        self.enter = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        for position, byte in literals:
            self.enter[byte, position // WORD] |= self._bit(position)
        for position, everything in loops:
            self.stay[:, position // WORD] |= self._bit(position)
            if not everything:
                self.stay[SLASH, position // WORD] &= ~self._bit(position)

    @staticmethod
    def _bit(position: int) -> np.uint64:
        return np.uint64(1 << (position % WORD))

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """A row per URL and a column per glob: whether the glob takes the whole URL."""
        lengths = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-lengths, kind="stable")
        offsets = (np.cumsum(lengths) - lengths)[order]
        data, ranked = np.frombuffer(b"".join(urls), np.uint8), -lengths[order]
        states = np.zeros((len(urls), self.words), np.uint64)
        for position in self.starts:
            states[:, position // WORD] |= self._bit(position)
        for step in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(ranked, -step, "left"))
            byte, now = data[offsets[:active] + step], states[:active]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(WORD - 1)
            states[:active] = (moved & self.enter[byte]) | (now & self.stay[byte])
        out = np.zeros((len(urls), len(self.ends)), bool)
        for k, position in enumerate(self.ends):
            out[order, k] = (states[:, position // WORD] & self._bit(position)) != 0
        return out


def matching_globs(canonical: Column, globs: Sequence[str]) -> Column:
    """The numbers of the globs that take the canonical URL, ascending."""

    @F.pandas_udf("array<int>")
    def matched(urls: pd.Series) -> pd.Series:
        automaton = GlobAutomaton(globs)
        found = automaton.match([u.encode() for u in urls])
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in found], index=urls.index)

    return matched(canonical)


def judge_urls(
    df: DataFrame,
    rules: Sequence[Rule],
    url_column: str = "url",
    id_column: str = "page_id",
    blocked: Sequence[str] = BLOCKED_GLOBS,
) -> DataFrame:
    """One row per input row: the id, ``host``, ``path``, ``rule`` and ``verdict``.

    Of the rules that fit, the longest wins (host and path counted together; of equal rules the
    first), and ``rule`` names it. Where none fits, ``rule`` is null and the verdict is ``block``
    if one of the ``blocked`` globs takes the URL, else ``allow``. A null URL, an empty one and
    one without ``://`` have empty host and path and are allowed. Repeated rows and null ids are
    judged like any other; all columns but the id and the URL are left behind.
    """
    ranked = sorted(rules, key=lambda rule: -len(rule.name))
    globs = [rule.glob for rule in ranked] + list(blocked)
    parts = df.select(
        df[id_column].alias(id_column), host(df[url_column]).alias("host"), path(df[url_column]).alias("path")
    )
    canonical = F.concat(F.lit("."), "host", "path")
    judged = parts.withColumn("glob", F.get(matching_globs(canonical, globs), 0))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, rule in enumerate(ranked):
        name = F.when(F.col("glob") == k, rule.name).otherwise(name)
        verdict = F.when(F.col("glob") == k, rule.verdict).otherwise(verdict)
    other = F.when(F.col("glob").isNull(), "allow").otherwise("block")
    return judged.select(
        id_column, "host", "path", name.alias("rule"), F.coalesce(verdict, other).alias("verdict")
    )
