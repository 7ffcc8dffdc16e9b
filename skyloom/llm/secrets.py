r"""Operator 8 (DataFrame functions only): secrets in texts.

Base spans come from three patterns; the method adds spans of kind `entropy`: a candidate string is a run of at least
WINDOW characters of a class, and a window of WINDOW characters slides over it while counts per character are kept up
to date by one increment and one decrement, from which the Shannon entropy follows. The largest window entropy at or
above the class's threshold makes the candidate a span, unless the allow-list knows it.

Positions come from the text between matches: split() gives the pieces around the matches that regexp_extract_all()
gives, and running sums of both lengths give start and end in code points. Most texts have neither an assignment nor a run
of WINDOW characters, which two cheap tests tell; the others are split once for each pattern.

Counts are kept in a few 64-bit words, COUNTERS to a word, so a step of the window costs the same for any alphabet.

Edge cases: a null text counts as empty and has no spans; base_sha256 and spans of a text without spans are those of
the empty string; each row of an id that repeats is scanned by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import narrow

#: Fixed values of the contract.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
#: Character classes: name, a run of its characters, what the run must have, bits a character.
CLASSES = (
    ("base64", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}", r"(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])", 3.8),
    ("hex", r"(?<![A-Za-z0-9])[0-9A-Fa-f]{20,}(?![A-Za-z0-9])", r"(?=.*[0-9])(?=.*[A-Fa-f])", 3.0),
)
#: Allow-list: strings that look random but are no secrets.
ALLOWED = (
    r"^(sha(1|256|384|512)|md5)[-:_]",  # content digests that name their algorithm
    r"(?i)example|sample|placeholder|dummy|changeme|x{6,}|0{8,}",
    r"^[A-Za-z]+([_-][A-Za-z]+)+\d{0,4}$",  # identifiers made of words
    r"(?i)^(https?|ftp)[:/]",
    r"(?i)abcdefghij|0123456789",  # alphabets
)


SPAN = "struct<s:int,e:int,k:int>"
#: Counts of 5 bits in a word; characters of candidates lie between FIRST and FIRST + COUNTERS * COUNTED.
COUNTERS, COUNTED, FIRST = 12, 7, ord("+")
LONG_RUN = rf"[A-Za-z0-9+/_-]{{{WINDOW}}}"


def bind(value, body):
    """body(value) with value computed once: a lambda's argument is a value, a column in its body would be an expression."""
    return F.get(F.transform(F.array(value), body), 0)


def spans_of(text, pattern: str, kind: str, accept):
    """array<struct<s,e,k>>: matches of pattern for which accept(match) holds, with positions in code points."""
    k = KINDS.index(kind)
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, m):
        s = acc["at"] + F.length(m["gap"])
        e = s + F.length(m["hit"])
        one = F.array(F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(k).alias("k")))
        return F.struct(e.cast("int").alias("at"), F.when(accept(m["hit"]), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # a gap before each hit and one after the last, which zipping leaves without a hit
    pairs = F.zip_with(F.split(text, pattern, -1), hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.aggregate(F.filter(pairs, lambda p: p["hit"].isNotNull()), start, step, lambda a: a["out"])


def window_entropy(s):
    """Largest Shannon entropy, in bits a character, of a window of WINDOW characters of s."""
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2)])
    ones = F.array(*[F.lit(1 << 5 * k).cast("long") for k in range(COUNTERS)])
    word, one = lambda c: F.floor(c / COUNTERS).cast("int"), lambda c: F.get(ones, c % COUNTERS)
    count = lambda w, c: F.call_function("shiftrightunsigned", F.get(w, word(c)), (c % COUNTERS * 5).cast("int")).bitwiseAND(F.lit(31)).cast("int")
    term = lambda n: F.get(terms, n)
    begin = F.struct(F.array_repeat(F.lit(0).cast("long"), COUNTED).alias("w"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def add(w, c, sign: int):
        return F.transform(w, lambda v, k: F.when(k == word(c), v + sign * one(c)).otherwise(v))

    def change(acc, i, c, old):
        """State after the character c comes in and, past the first window, `old` goes out."""
        full = i >= WINDOW
        w = F.when(full, add(acc["w"], old, -1)).otherwise(acc["w"])
        less = F.when(full, term(count(acc["w"], old)) - term(count(acc["w"], old) - 1)).otherwise(F.lit(0.0))

        def put(w):
            n = count(w, c)
            total = acc["sum"] - less - term(n) + term(n + 1)
            entropy = F.when(i >= WINDOW - 1, F.greatest(acc["best"], F.lit(math.log2(WINDOW)) - total / WINDOW)).otherwise(acc["best"])
            return F.struct(add(w, c, 1).alias("w"), total.alias("sum"), entropy.alias("best"))

        return bind(w, put)

    def best(codes):
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), begin, lambda acc, i: change(acc, i, F.get(codes, i), F.get(codes, i - WINDOW)), lambda a: a["best"])

    return bind(F.transform(F.split(s, ""), lambda c: F.ascii(c) - FIRST), best)


def joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans: one row for each row of docs(doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    t = narrow(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    col = F.col("t")
    none = F.array().cast(f"array<{SPAN}>")
    assign = F.when((col.contains("=") | col.contains(":")) & col.rlike(ASSIGN), spans_of(col, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)).otherwise(none)
    long_hex = HEX[:-1] + "{24,}"  # runs do not overlap, so those of 24 or more are the same as all runs, then dropped
    allowed = "|".join(f"(?:{a})" for a in ALLOWED)
    added = []
    for _, run, needs, bits in CLASSES:
        ok = lambda m, needs=needs, bits=bits: F.when(m.rlike("^" + needs) & ~m.rlike(allowed), window_entropy(m) >= bits).otherwise(F.lit(False))
        added.append(spans_of(col, run, "entropy", ok))
    # access keys, long hexadecimal numbers and candidates all are runs of WINDOW characters or more
    long_run = F.struct(spans_of(col, ACCESS, "access", lambda m: F.length(m) >= 20).alias("c"), spans_of(col, long_hex, "hex", lambda m: F.length(m) >= 24).alias("h"), F.array_distinct(F.concat(*added)).alias("x"))
    found = t.select("doc_id", assign.alias("a"), F.when(col.rlike(LONG_RUN), long_run).otherwise(F.struct(none.alias("c"), none.alias("h"), none.alias("x"))).alias("f"))
    s = found.select("doc_id", "a", "f.c", "f.h", "f.x")
    base = F.array_sort(F.concat("a", "c", "h"), lambda p, q: F.when(p["s"] != q["s"], p["s"] - q["s"]).otherwise(p["k"] - q["k"]))
    every = F.array_sort(F.concat("a", "c", "h", "x"), lambda p, q: F.when(p["s"] != q["s"], p["s"] - q["s"]).otherwise(p["k"] - q["k"]))
    return s.select(
        "doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("c", "n_access"), ("h", "n_hex"), ("x", "n_entropy"))],
        F.sha2(joined(base), 256).alias("base_sha256"), joined(every).alias("spans"),
    )


def _sql() -> str:
    """Every window of every candidate anew; candidates without look-around, which DuckDB lacks."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    # a hexadecimal candidate is a run of letters and digits that is hexadecimal as a whole
    runs = (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("base64", r"[A-Za-z0-9+/_-]{%d,}={0,2}" % WINDOW), ("alnum", "[A-Za-z0-9]+"))
    found = " UNION ALL ".join(f"SELECT r, '{k}' AS run, regexp_extract_all(t, {quoted(p)}, 0) AS hits, string_split_regex(t, {quoted(p)}) AS gaps FROM d" for k, p in runs)
    allowed = " OR ".join(f"regexp_matches(m, {quoted(a)})" for a in ALLOWED)
    entropy = f"list_max(list_transform(range(1, length(m) - {WINDOW} + 2), lambda a: list_aggregate(string_split(m[a:a + {WINDOW} - 1], ''), 'entropy')))"
    has = lambda *x: " AND ".join(f"regexp_matches(m, '{c}')" for c in x)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
u AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM f),
h AS (SELECT r, run, hits[i] AS m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM u),
c AS (SELECT r, s, s + length(m) AS e, m, CASE run WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END AS k,
  CASE run WHEN 'assign' THEN length(regexp_extract(m, {quoted(ASSIGN)}, 2)) >= 6 WHEN 'access' THEN length(m) >= 20 WHEN 'hex' THEN length(m) >= 24
    WHEN 'base64' THEN {has('[0-9]', '[A-Z]', '[a-z]')} AND NOT ({allowed}) ELSE regexp_full_match(m, '[0-9A-Fa-f]{{{WINDOW},}}') AND {has('[0-9]', '[A-Fa-f]')} AND NOT ({allowed}) END AS ok,
  CASE run WHEN 'base64' THEN {CLASSES[0][3]} WHEN 'alnum' THEN {CLASSES[1][3]} END AS bits FROM h),
x AS (SELECT DISTINCT r, s, e, k FROM c WHERE ok AND (bits IS NULL OR CASE WHEN length(m) >= {WINDOW} THEN {entropy} ELSE 0 END >= bits)),
y AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy,
  string_agg({list(KINDS)}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({list(KINDS)}[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, coalesce(n_entropy, 0)::BIGINT AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN y USING (r)
"""


ORACLE_SQL = _sql()
