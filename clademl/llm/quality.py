"""Line-first cleaning: rules on each line, then a verdict on how much of a document is left."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clademl.llm.common import refuse_clash
from clademl.llm.words import pair_numbers, split_words, word_numbers

#: Fixed values of the base rules: symbols counted, words a document needs, length of a repeated window, and the
#: percent of words in such windows from which a document fails.
SYMBOLS, LEAST_WORDS, WINDOW, MOST_REPEATED = "#*$%&|<>", 20, 8, 30


@dataclass(frozen=True)
class LineRules:
    """Rules on one line; each pattern is plain enough to mean the same in Python and SQL.

    ``sentence``: a line must hold the end of a sentence. ``symbols_percent``: it fails if its symbols are more
    than this share of its characters in words. ``separator``, ``most_separators``, ``separator_percent``:
    a menu or table row, with more separators than the number and than the share of its words.
    ``boilerplate``: stock phrases, in lower case. ``least_percent``: a document whose passing lines hold less
    than this share of its words is rejected.
    """

    sentence: str = r"""[.!?:;…。！？؟।]["'»”’)\]]*([\x20\t]|$)"""
    symbols_percent: int = 10
    separator: str = r"(^|[\x20\t])(\||>|»|›|•|·|/|::)([\x20\t]|$)"
    most_separators: int = 2
    separator_percent: int = 15
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "use of cookies",
        "enable javascript", "lorem ipsum", "click here", "read more", "sign in", "sign up", "log in", "subscribe to", "share on",
        "powered by", "skip to content", "skip to main content", "licensed under", "released under", "copyright ©", "copyright (c)")
    least_percent: int = 50


_WHITE = "\x20\t\x0b\x0c\r"
_BARS = "|>»›•·/:"


def _low(text: str) -> str:
    return text.encode().lower().decode()  # A-Z only


def failed_rule(line: str, words: int, rules: LineRules, symbols: bool = True, stock: tuple[str, ...] | None = None) -> str:
    """The first rule that a line of ``words`` words breaks: ``navigation``, ``punctuation``, ``boilerplate``; or ``""``.

    ``symbols`` and ``stock`` may say that the whole text has no symbol, or which stock phrases it has.
    """
    line = line.strip(_WHITE)
    if sum(map(line.count, _BARS)) > rules.most_separators:
        bars = len(re.findall(rules.separator, line))
        if bars > rules.most_separators and 100 * bars > rules.separator_percent * words:
            return "navigation"
    if not re.search(rules.sentence, line):
        return "punctuation"
    if symbols and 100 * sum(map(line.count, SYMBOLS)) > rules.symbols_percent * (len(line) - sum(map(line.count, _WHITE))):
        return "punctuation"
    stock = rules.boilerplate if stock is None else stock
    return "boilerplate" if stock and any(p in _low(line) for p in stock) else ""


def repeated_words(numbers: np.ndarray, edges: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each text, the words in windows of ``window`` words that occur at two places of the text or more.

    Windows are numbered exactly by doubling (pairs of words, pairs of pairs, ...), all texts of a batch at once.
    """
    n, texts = len(numbers), len(edges) - 1
    text = np.repeat(np.arange(texts), np.diff(edges))
    hit = np.zeros(n, bool)
    if n >= window:
        key, size = numbers, 1
        while size < window:  # overlapping halves make any length
            step = min(size, window - size)
            key = pair_numbers(key[: len(key) - step], key[step:])
            size += step
        inside = text[: len(key)] == text[window - 1 :]  # not across two texts
        at = np.flatnonzero(inside)
        if len(at):
            again = pair_numbers(text[at], key[at])
            start = at[np.bincount(again)[again] > 1]
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, start, 1)
            np.add.at(mark, start + window, -1)
            hit = np.cumsum(mark)[:n] > 0
    return np.bincount(text[hit], minlength=texts)


def clean_lines(docs: DataFrame, rules: LineRules = LineRules(), keep: tuple[str, ...] = (), id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Line rules first, then documents: ``doc_id``, the base counts ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words``, ``base_failed``, ``kept``, what the lines lost by rule (``n_lines, cut_punctuation,
    cut_navigation, cut_boilerplate``, lines with a word), ``n_words_left`` and ``cleaned``, the text without the
    lines that failed (lines without a word stay).

    Every line with a word is judged by itself and removed if it breaks a rule; a document fails if fewer than
    20 words or over 30 % of its words lie in repeated 8-word windows (``base_failed``), and it is rejected too if the
    lines left hold less than ``rules.least_percent`` percent of its words. Words are those between ASCII white
    space, in whole texts. Rows are independent: no shuffle, and a task holds one batch of texts.

    Null or empty text: no words, fails; ``cleaned`` is null for null and empty for empty. Null ids, repeated
    rows and ties: each row has its own result. An empty table gives no row. Other columns are not read unless
    named in ``keep``.
    """
    own = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "base_failed": "boolean", "kept": "boolean", "n_lines": "long", "cut_punctuation": "long", "cut_navigation": "long",
           "cut_boilerplate": "long", "n_words_left": "long", "cleaned": "string"}
    refuse_clash(keep, "doc_id", "_text", *own)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t if isinstance(t, str) else None for t in b["_text"]]
            words = [split_words(t) for t in texts]
            repeat = repeated_words(*word_numbers(words))
            rows = [_judge(t, len(ws), int(r), rules) for t, ws, r in zip(texts, words, repeat, strict=True)]
            out = pd.DataFrame(rows, columns=list(own))
            yield pd.concat([b.drop(columns="_text").reset_index(drop=True), out], axis=1)

    base = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    fields = [f for f in base.schema.fields if f.name != "_text"]
    schema = T.StructType(fields + [T.StructField(c, T._parse_datatype_string(k)) for c, k in own.items()])
    return base.mapInPandas(run, schema)


def _judge(text: str | None, n: int, repeated: int, rules: LineRules) -> tuple:
    body = text or ""
    lines = body.split("\n")
    worded = [len(split_words(x)) for x in lines] if len(lines) > 1 else [n]
    with_word = [x for x, w in zip(lines, worded, strict=True) if w]
    symbols, low = sum(map(body.count, SYMBOLS)), _low(body)
    stock = tuple(p for p in rules.boilerplate if p in low)
    broken = [failed_rule(x, w, rules, symbols > 0, stock) if w else "" for x, w in zip(lines, worded, strict=True)]
    left = sum(w for w, f in zip(worded, broken, strict=True) if not f)
    base = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return (n, len(body) - sum(map(body.count, _WHITE + "\n")), symbols,
            len(with_word) - len(set(with_word)), repeated, base, not base and 100 * left >= rules.least_percent * n, len(with_word),
            broken.count("punctuation"), broken.count("navigation"), broken.count("boilerplate"), left,
            None if text is None else "\n".join(x for x, f in zip(lines, broken, strict=True) if not f))


def report(cleaned: DataFrame) -> DataFrame:
    """The counts and the verdict, without the cleaned text."""
    return cleaned.drop("cleaned")


def _sql(rules: LineRules) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    size = r"length(regexp_replace(x, '[\x20\t\x0B\x0C\r]', '', 'g'))"
    low = "translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    stock = " OR ".join(f"contains({low}, {q(p)})" for p in rules.boilerplate)
    bars = f"len(regexp_extract_all(x, {q(rules.separator)}))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, hash(w[i + 1 : i + {WINDOW}]) AS h FROM (SELECT r, w, unnest(range(0, len(w) - {WINDOW - 1})) AS i FROM w WHERE len(w) >= {WINDOW})),
v AS (SELECT r, h FROM g GROUP BY r, h HAVING count(*) > 1),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS j FROM g SEMI JOIN v USING (r, h)) GROUP BY r),
l AS (SELECT r, l, trim(l, E'\x20\x09\x0B\x0C\x0D') AS x, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d)),
f AS (SELECT r, l, n, CASE WHEN {bars} > {rules.most_separators} AND 100 * {bars} > {rules.separator_percent} * n THEN 'n'
  WHEN NOT regexp_matches(x, {q(rules.sentence)}) OR 100 * len(regexp_extract_all(x, '[#*$%&|<>]')) > {rules.symbols_percent} * {size} THEN 'p'
  WHEN {stock} THEN 'b' ELSE '' END AS f FROM l WHERE n > 0),
s AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT l) AS dup, count(*) FILTER (f = 'p') AS cp, count(*) FILTER (f = 'n') AS cn,
  count(*) FILTER (f = 'b') AS cb, coalesce(sum(n) FILTER (f = ''), 0) AS remain FROM f GROUP BY r),
a AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  coalesce(lines, 0)::BIGINT AS n_lines, coalesce(cp, 0)::BIGINT AS cut_punctuation, coalesce(cn, 0)::BIGINT AS cut_navigation,
  coalesce(cb, 0)::BIGINT AS cut_boilerplate, coalesce(remain, 0)::BIGINT AS n_words_left
  FROM d JOIN w USING (r) LEFT JOIN p USING (r) LEFT JOIN s USING (r))
SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AND 100 * n_words_left >= {rules.least_percent} * n_words AS kept FROM a
"""


ORACLE = _sql(LineRules())
