"""Secret scan through a trigram inverted index; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademl.llm.common import bounded_broadcast, stored


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the least length of a group of each match (0: the match), and
    optionally a pattern found in every text that has a long enough match, tried first."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    probe: str = ""


#: Fixed values of the base rules.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
#: Further well-known formats.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[opsru]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
)

#: A query: every clause must hold; a clause holds if one alternative has all its trigrams in the text.
Query = tuple[tuple[frozenset[str], ...], ...]
_MOST = 64


def _trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def _clause(strings: set[str]) -> list[tuple[frozenset[str], ...]]:
    """The clause that one of these strings occurs; none if one is too short to have a trigram."""
    if not strings or min(map(len, strings)) < 3:
        return []
    sets = {_trigrams(s) for s in strings}
    return [tuple(sorted((a for a in sets if not any(b < a for b in sets)), key=sorted))]


def _strings(node) -> set[str] | None:
    """All texts that a parsed piece can match, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN and all(o is C.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    if op is C.SUBPATTERN:
        return _sequence(arg[3])
    if op is C.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        return None if any(p is None for p in parts) or sum(map(len, parts)) > _MOST else set().union(*parts)
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1:
        inner = _sequence(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    if op is C.AT:
        return {""}
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        s = _strings(n)
        if s is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _clauses(nodes) -> list[tuple[frozenset[str], ...]]:
    out, run = [], {""}
    for n in nodes:
        s = _strings(n)
        if s is not None and len(run) * len(s) <= _MOST:
            run = {a + b for a in run for b in s}
            continue
        out += _clause(run)
        run = s if s is not None else {""}
        if s is None:
            op, arg = n
            if op is C.SUBPATTERN:
                out += _clauses(arg[3])
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                out += _clauses(arg[2])
    return out + _clause(run)


def trigram_query(pattern: str) -> Query:
    """Trigrams (of lower-cased text) that every match of ``pattern`` needs; empty if there are none.

    Runs of pieces that match few texts are multiplied out; whatever can match many texts ends a run
    and asks for nothing itself. An alternation is a clause with an alternative for each branch.
    """
    return tuple(dict.fromkeys(_clauses(P.parse(pattern))))


def postings(rows: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """The inverted index of the queries' trigrams: ``(gram, key)`` of each text that holds it."""
    grams = sorted({g for q in queries.values() for clause in q for a in clause for g in a})
    low = F.lower("text")
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("low"), g))
    return rows.select("key", low.alias("low")).select("key", F.explode(held).alias("gram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``key, rules``: texts whose postings meet a rule's query. Postings are intersected by counting:
    an alternative holds for a key that is in the lists of all its trigrams."""
    terms = [(kind, c, a, g, len(alt), len(q)) for kind, q in queries.items() for c, clause in enumerate(q)
             for a, alt in enumerate(clause) for g in sorted(alt)]
    spark = index.sparkSession
    table = spark.createDataFrame(terms, "kind string, clause int, alt int, gram string, grams int, clauses int")
    met = (index.join(F.broadcast(table), "gram")  # a row for each trigram of each rule
           .groupBy("key", "kind", "clause", "alt", "grams", "clauses").agg(F.count_distinct("gram").alias("n"))
           .filter("n = grams").groupBy("key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).filter("n = clauses"))
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))


def _spans(rule: Rule, order: int) -> Column:
    """Verified matches of one rule in ``text``, as structs of start, order, kind and end.

    The pieces between matches and the matches alternate, so running sums of their lengths (in code
    points) give the positions.
    """
    regex = F.lit(rule.pattern)
    whole = F.regexp_extract_all("text", regex, F.lit(0))
    sized = whole if rule.group == 0 else F.regexp_extract_all("text", regex, F.lit(rule.group))
    pieces = F.zip_with(F.zip_with(F.split("text", rule.pattern, -1), whole, lambda g, m: F.struct(F.char_length(g).cast("long").alias("gap"), F.char_length(m).cast("long").alias("size"))),
                        sized, lambda p, s: p.withField("held", F.char_length(s)))
    empty = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        end = start + p["size"]
        ok = p["held"] >= rule.least
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(ok, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    walked = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)["out"]
    return F.when(F.regexp_like("text", F.lit(rule.probe or rule.pattern)), walked).otherwise(empty)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: verified matches as structs ``start, order, kind, end`` (code points, end
    exclusive), ordered by start and then by the order of ``rules``.

    Each rule's pattern gives a Boolean trigram query. An inverted index of the queries' trigrams is
    written to the shared folder, postings are intersected by counting, and only candidate texts
    meet such a rule's pattern. Rules without mandatory trigrams scan every text. A text is known to
    the index by a hash of its row; a collision costs a needless check, never a match.

    Null or empty text: no span. Null or repeated ``doc_id``: each row on its own. An empty table
    gives no row. Other columns are not read.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    if queries:
        found = stored(candidates(stored(postings(rows, queries), "postings"), queries), "candidates")
        rows = rows.join(bounded_broadcast(found, found.count(), 256), "key", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,order:int,kind:string,end:bigint>>")
    each = [F.when(F.array_contains("rules", r.kind), _spans(r, i)).otherwise(none) if r.kind in queries else _spans(r, i)
            for i, r in enumerate(rules)]
    return rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(found: DataFrame) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    return found.select("doc_id", *(count(r.kind) for r in BASE), F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
