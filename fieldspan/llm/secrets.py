"""Secrets in documents, found through a trigram index.

From each rule's regular expression a Boolean trigram query is derived: an AND of groups, each an OR
of strings all of whose trigrams must occur. The index posts each document under the trigrams that
some query names; the postings are intersected per document, and only candidates are verified with
the rule. A rule without a mandatory trigram (long hexadecimal runs) is verified on every document.

All of it is DataFrame code. Positions come from the lengths of the text's pieces between matches,
so they count code points.

Edge cases: null text counts as empty and has no spans; texts of any length are scanned whole;
repeated rows give a row each; null ids are kept.
"""

from __future__ import annotations

from functools import reduce
from itertools import product
from re import _parser as regex_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_id_of, doc_rows, packed, split_by_keys, staged, unpacked


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  #: the group whose length counts
    least: int = 0  #: matches with a shorter group are dropped (they still use up their text)


#: The base kinds, in the order in which they are listed. Runs of one class are matched
#: with their least length at once, which finds the same matches as dropping short runs afterwards.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds of this operator.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
#: Sets of strings larger than this are not followed further.
MOST_STRINGS = 64


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """AND of groups; a group is an OR of sets of trigrams (lower case), all of which must occur."""
    groups: list[list[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        if strings and all(len(x) >= 3 for x in strings):
            sets = {frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in strings}
            groups.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))  # a weaker option covers a stronger
        return {""}

    def finite(item) -> set[str] | None:
        """All the strings an item can match, or None if they are many or unbounded."""
        kind, value = str(item[0]), item[1]
        if kind == "LITERAL":
            return {chr(value).lower()}
        if kind == "IN":
            out: set[str] = set()
            for x, v in value:
                if str(x) == "LITERAL":
                    out.add(chr(v).lower())
                elif str(x) == "RANGE" and v[1] - v[0] < 4:
                    out |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
                else:
                    return None
            return out
        if kind == "SUBPATTERN":
            return sequence(value[3])
        if kind == "BRANCH":
            parts = [sequence(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if kind == "MAX_REPEAT" and value[1] != regex_parser.MAXREPEAT and value[1] <= 3:
            one, out = sequence(value[2]), set()
            if one is None:
                return None
            for n in range(value[0], value[1] + 1):
                out |= {"".join(x) for x in product(one, repeat=n)}
            return out if len(out) <= MOST_STRINGS else None
        return None

    def sequence(items) -> set[str] | None:
        strings = {""}
        for item in items:
            part = finite(item)
            if part is None or len(strings) * len(part) > MOST_STRINGS:
                return None
            strings = {a + b for a in strings for b in part}
        return strings

    strings = {""}
    for item in regex_parser.parse(pattern):
        part = finite(item)
        if part is None or len(strings) * len(part) > MOST_STRINGS:
            strings = close(strings)
            part = part or {""}
        strings = {a + b for a in strings for b in part}
    close(strings)
    return groups


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """kid, h, gram: the index over the trigrams that queries name."""
    low = rows.select("kid", "h", F.lower("text").alias("low"))
    found = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams)))
    return low.select("kid", "h", F.explode(found).alias("gram"))


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> tuple[DataFrame, list[str]]:
    """kid, h and a flag c_<kind> for each rule with a trigram query; the kinds of those rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for group in q for option in group for g in option})
    place = {g: i for i, g in enumerate(grams)}
    has = F.transform(F.array(*map(F.lit, grams)), lambda g: F.array_contains(F.col("grams"), g))
    # At most one entry a trigram of the queries, so the gathered sets are small.
    rows_of = postings(rows, grams).groupBy("kid", "h").agg(F.collect_set("gram").alias("grams")).select("kid", "h", has.alias("has"))

    def holds(query) -> Column:
        whole = F.lit(True)
        for group in query:
            some = F.lit(False)
            for option in group:
                every = F.lit(True)
                for g in sorted(option):
                    every = every & F.col("has")[place[g]]
                some = some | every
            whole = whole & some
        return whole

    return rows_of.select("kid", "h", *(holds(q).alias(f"c_{k}") for k, q in queries.items())), list(queries)


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, in code points."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    lengths = F.transform(F.arrays_zip(whole.alias("m"), value.alias("v"), gaps.alias("g")), lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("m"), F.length(x["v"]).alias("v")))
    lengths = F.filter(lengths, lambda x: x["m"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + x["g"]
        kept = F.when(x["v"] >= rule.least, F.array(F.struct(begin.alias("start"), (begin + x["m"]).alias("end")))).otherwise(empty)
        return F.struct((begin + x["m"]).alias("at"), F.concat(a["out"], kept).alias("out"))

    return F.when(F.regexp_like(text, pattern), F.aggregate(lengths, start, step, lambda a: a["out"])).otherwise(empty)


def _listed(names: list[str]) -> Column:
    """The spans of the kinds, by start and then by kind: array<struct<start, at, end, kind>>."""

    def named(i: int, kind: str) -> Column:
        return F.transform(F.col("spans")[kind], lambda x: F.struct(x["start"].alias("start"), F.lit(i).alias("at"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.array_sort(F.concat(*(named(i, k) for i, k in enumerate(names))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat(x["kind"], F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def _scanned(keyed: DataFrame, docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``keyed`` (kid, h, text, ...) with ``spans``: a struct of an array of spans for each rule.

    Only documents that are candidates of some rule, and a few others, move to meet their flags; in the
    rest only rules without a trigram query are verified, where they lie.
    """
    flags, indexed = candidates(doc_rows(docs), rules)
    wanted = staged(flags.where(reduce(Column.__or__, (F.col(f"c_{k}") for k in indexed), F.lit(False))))
    some, others = split_by_keys(keyed, wanted)
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def spans(flagged: bool) -> Column:
        of = [(F.when(F.col(f"c_{r.kind}"), spans_of(text, r)).otherwise(none) if flagged else none) if r.kind in indexed else spans_of(text, r) for r in rules]
        return F.struct(*(x.alias(r.kind) for x, r in zip(of, rules))).alias("spans")

    found = some.join(wanted.hint("shuffle_hash"), ["kid", "h"], "left")
    return found.select(*keyed.columns, spans(True)).union(others.select(*keyed.columns, spans(False)))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: how many secrets of each base kind, and all spans."""
    names, base = [r.kind for r in rules], [r.kind for r in BASE]
    found = _scanned(doc_rows(docs), docs, rules)
    return found.select(
        doc_id_of(F.col("kid")),
        *(F.size(F.col("spans")[k]).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(_listed(base)), 256).alias("base_sha256"),
        _joined(_listed(names)).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each secret replaced by its kind in brackets (overlapping ones by the first's) and n_chars renewed."""
    listed = _scanned(packed(docs), docs, rules).withColumn("listed", _listed([r.kind for r in rules]))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = x["start"] >= a["at"]
        clean = F.substring(F.col("text"), a["at"] + 1, x["start"] - a["at"])
        return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(fresh, F.concat(a["out"], clean, F.lit("["), x["kind"], F.lit("]"))).otherwise(a["out"]).alias("out"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text")))
    text = F.when(F.size("listed") > 0, F.aggregate("listed", start, step, rest)).otherwise(F.col("text"))
    clean = listed.select("row", text.alias("clean"))
    return unpacked(clean, text=F.col("clean"), n_chars=F.length("clean").cast("long"))
