"""Secret scans by a trigram inverted index, in built-in column functions only.

Each rule is a regular expression. From its parse a Boolean query over trigrams is derived that
every match must satisfy: a conjunction for what stands in sequence, a disjunction for
alternatives. The index has, for each block of documents and each trigram that some query names,
the posting list of documents whose lower-cased text holds it. A query is answered by
intersecting and uniting posting lists; only its candidates are verified with the expression.
A rule without mandatory trigrams (``hex``) is verified on every text.

Defined cases
-------------
* Null text counts as empty: no spans, the digest of the empty string.
* Rows are scanned one by one: repeated rows and ids repeat their results, a null id is kept.
* Whole texts are scanned; offsets count code points, ends are exclusive.
* Further columns are ignored. An empty table gives no rows.
* Any number of matches and runs of any length: matching is linear in the text, and places of n
  matches are running sums in log2(n) linear passes.

A posting list holds one block of ids, so its length is bounded. Texts are not shuffled while the
candidates' ids fit the broadcast bound; beyond it they are joined by id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, shared_table

#: Ids per block of the index.
BLOCK = 4096
#: Trigrams that are kept of one run of literals, its first and its last ones. Fewer are a weaker
#: query, never a wrong one, and each costs a pass over the text.
PER_RUN = 2


@dataclass(frozen=True)
class Rule:
    """``least`` is the smallest length of ``group`` for a match to count.

    ``tight`` is an equal expression with that length inside, for patterns whose matches are
    maximal runs: short runs, of which a text has thousands, then never become rows of an array.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = False
    tight: str = ""


# No rule repeats a group, which Java's matcher does by recursion, and none begins with a run that
# each of the run's places would scan anew: a scan is linear in the text, whatever the text.

# The base kinds.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True, r"[0-9a-f]{24,}"),
)

RULES = BASE_RULES + (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"(?:ghp|gho|ghs|ghu|ghr|github_pat)_[A-Za-z0-9_]+", 0, 36),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 16),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"(?<![a-z])[a-z]++://[^\x20\x09-\x0D:@/]+:[^\x20\x09-\x0D:@/]+@"),
)

# ---------------------------------------------------------------- Boolean queries
#: A query: True (all documents), a trigram, ("and", parts) or ("or", parts).
Query = bool | str | tuple


def _combine(op: str, parts: list[Query]) -> Query:
    if op == "and":
        parts = [p for p in parts if p is not True]
        if not parts:
            return True
    elif any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _trigrams(run: str) -> Query:
    found = [run[i : i + 3] for i in range(len(run) - 2)]
    return _combine("and", found if len(found) <= PER_RUN else found[: PER_RUN - 1] + found[-1:])


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that the lower-cased text of any match satisfies."""

    def of(items) -> Query:
        parts: list[Query] = []
        run = ""
        for op, arg in items:
            if op is sre.LITERAL:
                run += chr(arg).lower()
                continue
            if op is sre.SUBPATTERN and all(o is sre.LITERAL for o, _ in arg[3]):
                run += "".join(chr(a).lower() for _, a in arg[3])
                continue
            parts.append(_trigrams(run))
            run = ""
            if op is sre.SUBPATTERN:
                parts.append(of(arg[3]))
            elif op is sre.BRANCH:
                parts.append(_combine("or", [of(alternative) for alternative in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                parts.append(of(arg[2]))
        parts.append(_trigrams(run))
        return _combine("and", parts)

    return of(sre_parse.parse(pattern))


def trigrams_in(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_in, query[1]))


# ---------------------------------------------------------------- index and candidates
def trigram_postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """``(block, p_0, p_1, ...)``: for each block of ids the sorted posting list of each trigram."""
    # Exploding an array of one keeps the optimizer from lower-casing the text again for each trigram.
    low = docs.select("key", F.explode(F.array(F.lower("text"))).alias("low"))
    present = F.filter(
        F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams))), lambda x: x.isNotNull()
    )
    rows = low.select("key", F.explode(present).alias("t"))
    return rows.groupBy(F.floor(F.col("key") / BLOCK).alias("block")).agg(
        *(F.collect_set(F.when(F.col("t") == i, F.col("key"))).alias(f"p_{i}") for i in range(len(trigrams)))
    )


def _answer(query: Query, at: dict[str, str]) -> Column:
    if isinstance(query, str):
        return F.col(at[query])
    op = F.array_intersect if query[0] == "and" else F.array_union
    out = _answer(query[1][0], at)
    for part in query[1][1:]:
        out = op(out, _answer(part, at))
    return out


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(key, mask)``: bit i of the mask says that rule i may match; rules that scan fully are left out."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted(set().union(*map(trigrams_in, queries)))
    at = {t: f"p_{i}" for i, t in enumerate(trigrams)}
    index = trigram_postings(docs, trigrams)

    def with_bit(keys: Column, bit: int) -> Column:
        return F.transform(keys, lambda key: F.struct(key.alias("key"), F.lit(bit).alias("bit")))

    answers = [with_bit(_answer(q, at), 1 << i) for i, q in enumerate(queries) if q is not True]
    return index.select(F.explode(F.concat(*answers)).alias("x")).groupBy("x.key").agg(F.bit_or("x.bit").alias("mask"))


# ---------------------------------------------------------------- verification
def _java(rule: Rule) -> str:
    return ("(?i)" if rule.fold else "") + (rule.tight or rule.pattern)


SPAN = "struct<start:int,rank:int,kind:string,end:int,first_byte:int,end_byte:int>"


def _running(values: Column, op) -> Column:
    """Running fold of an array of structs by an associative ``op``: log2(n) rounds of one linear pass."""
    powers = F.array(*(F.lit(1 << i) for i in range(31)))

    def fold(all_of_them):
        steps = F.filter(powers, lambda p: p < F.size(all_of_them))
        return F.aggregate(
            steps, all_of_them, lambda acc, p: F.transform(acc, lambda x, i: F.when(i >= p, op(F.get(acc, i - p), x)).otherwise(x))
        )

    # As the one entry of an array ``values`` is evaluated once, however often the fold names it.
    return F.get(F.transform(F.array(values), fold), F.lit(0))


def _spans(rule: Rule, i: int) -> Column:
    """Array of ``SPAN`` of one rule in ``text``; code points, and bytes too for cutting."""
    pattern = F.lit(_java(rule))
    # The pieces between matches, and the matches; the piece after the last match has no partner and goes.
    columns = [F.split("text", _java(rule), -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("hit")]
    if rule.group:
        columns.append(F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("kept"))

    def sizes(x):
        n, n_bytes = F.length(x["hit"]), F.octet_length(x["hit"])
        return F.struct(
            (F.length(x["gap"]) + n).alias("end"), (F.octet_length(x["gap"]) + n_bytes).alias("end_byte"), n.alias("n"), n_bytes.alias("n_bytes"),
            (F.length(x["kept" if rule.group else "hit"]) >= rule.least).alias("ok"),
        )

    def plus(a, b):
        return F.struct((a["end"] + b["end"]).alias("end"), (a["end_byte"] + b["end_byte"]).alias("end_byte"), *(b[c].alias(c) for c in ("n", "n_bytes", "ok")))

    def span(x):
        return F.struct(
            (x["end"] - x["n"]).alias("start"), F.lit(i).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"),
            (x["end_byte"] - x["n_bytes"]).alias("first_byte"), x["end_byte"].alias("end_byte"),
        )

    met = F.filter(F.transform(F.arrays_zip(*columns), sizes), lambda x: x["ok"].isNotNull())
    spans = F.transform(F.filter(_running(met, plus), lambda x: x["ok"]), span)
    return F.when(F.regexp_like("text", pattern), spans).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``secret_spans``: an array of ``SPAN``, by start and then by the rules' order.

    Names of its own work begin with ``secret_``; ``docs`` is kept inside a struct meanwhile, so
    its columns can't clash with them.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))
    source = docs.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = broadcast_if_small(shared_table(candidates(source, rules), "secret-candidates"))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    joined = docs.select(F.struct("*").alias("row"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(found, "key", "left")
    per_rule = []
    for i, rule in enumerate(rules):
        spans = _spans(rule, i)
        if trigram_query(rule.pattern) is not True:
            spans = F.when(F.col("mask").bitwiseAND(1 << i) != 0, spans).otherwise(none)
        per_rule.append(spans)
    return joined.select("row", F.sort_array(F.concat(*per_rule)).alias("secret_spans"))


def joined_spans(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, one row per document."""
    n = sum(r.base for r in rules)
    out = secret_spans(docs.select("doc_id", "text"), rules)
    base = F.filter("secret_spans", lambda s: s["rank"] < n)
    count = lambda i: F.size(F.filter("secret_spans", lambda s: s["rank"] == i)).cast("long")
    return out.select(
        "row.doc_id",
        *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base),
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("secret_spans")).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; spans that overlap are replaced as one. Null texts stay null."""
    out = secret_spans(docs, rules)
    # Where the spans up to each one end; a span that begins before its predecessors end overlaps one of them.
    ends = F.transform("secret_spans", lambda s: F.struct(s["first_byte"].alias("first"), s["end_byte"].alias("end")))
    upto = _running(ends, lambda a, b: F.struct(b["first"].alias("first"), F.greatest(a["end"], b["end"]).alias("end")))
    out = out.select("row", upto.alias("secret_spans"))

    def cut(raw):
        def piece(x, i):
            at = F.when(i == 0, F.lit(0)).otherwise(F.get("secret_spans", i - 1)["end"])
            gap = F.substring(raw, at + 1, x["first"] - at).cast("string")
            return F.when(x["first"] >= at, F.concat(gap, F.lit(mark)))

        last = F.element_at("secret_spans", -1)["end"]
        rest = F.substring(raw, last + 1, F.octet_length(raw)).cast("string")
        return F.concat(F.array_join(F.transform("secret_spans", piece), ""), rest)

    # The bytes are the entry of an array, so that they are taken from the row once and not for each span.
    clean = F.get(F.transform(F.array(F.col("row.text").cast("binary")), cut), F.lit(0))
    new = F.when(F.size("secret_spans") > 0, clean).otherwise(F.col("row.text"))
    return out.select(*((new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
