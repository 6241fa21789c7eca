"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose candidate spans in whole texts, good ones and bad: the base patterns without their checks, obfuscated
addresses, national phone numbers, and every run of 16 or more letters and digits, be it a word, a number, a digest or a
key. Five labelers vote on each, for (+1), against (-1) or not at all (0): its shape, its checksum, range or alphabet, a
gazetteer (top-level domains, card issuers, reserved networks, names that stand before secrets and before digests), cue
words before it, and its neighbouring characters. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is, without labels; a logistic span classifier is then trained on the posteriors and accepts
or rejects every candidate that is not a base span. The counts are one row per (pattern, votes, length class), at most
7 x 3**5 x 8 rows however large the corpus is, and come from every candidate of every document.

Base spans, those of :data:`BASE` that pass their check, always stay, as the operator's contract has it; they are
evidence for the estimates. Offsets are code points, end exclusive.

Defined cases: null text counts as empty and has no spans; repeated rows are scored alike; spans of different kinds may
overlap, added spans of a kind never overlap base spans of it; an empty table gives an empty result; further columns
are ignored. Patterns are possessive, so their time is linear in the text also for very long runs of one character.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.llm.common import materialize, no_nulls

KINDS = ("email", "ip", "card", "phone", "secret")
_WORD = "[A-Za-z0-9._%+-]"
#: (kind, pattern, what must occur for the pattern to be tried). The first four are the base patterns. Where a failed match would
#: fail again from each later character of the same run, a look-behind keeps to the run's first; \G allows for a match just before.
BASE = (
    ("email", rf"(?:(?<!{_WORD})|\G){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "digit"),
    ("card", r"[0-9](?:[ -]?+[0-9])++", "digit"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", "digit"),
)
LOOSE = (
    ("email", rf"(?<!{_WORD}){_WORD}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)++", "at"),
    ("phone", r"(?<![+0-9(). -])\(?[0-9]{3}\)?[ -][0-9]{3}-[0-9]{4}(?![0-9-])", "digit"),
    # any long run of letters and digits: words, numbers, digests and keys alike, in texts that have a digit, as keys do
    ("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+", "digit"),
)
PATTERNS = BASE + LOOSE
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Cue words before a hit, by kind.
_CUES = {
    "email": r"(?i)(?:e-?mail|contact|write|reach|to|at|from)[^A-Za-z]{0,6}$",
    "ip": r"(?i)(?:ip|host|address|server|from|login)[^A-Za-z]{0,6}$",
    "card": r"(?i)(?:card|visa|mastercard|amex|account|pay(?:ment)?)[^A-Za-z]{0,12}$",
    "phone": r"(?i)(?:tel|telephone|phone|mobile|call|fax)[^A-Za-z]{0,6}$",
    "secret": r"[=:][ \t]*+[\"']?+$",
}
_TOP_DOMAINS = ("com", "net", "org", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "eu")
#: Names before a long run that say that it is a secret, and that it is not.
_SECRET_NAMES = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|(?:api|access|private)[ _-]?key|auth|bearer|credentials?)[^A-Za-z0-9]{0,6}$"
_PUBLIC_NAMES = r"(?i)(?:commit|sha-?[0-9]*|md5|digest|checksum|revision|uuid|isbn|version|hash|href|src|path)[^A-Za-z0-9]{0,6}$"
LABELERS = ("shape", "check", "gazetteer", "context", "neighbours")


def _vote(yes: F.Column, no: F.Column | None = None) -> F.Column:
    """+1, -1 or, where neither holds, 0; without ``no`` all else is -1."""
    return F.when(yes, 1).otherwise(F.lit(-1) if no is None else F.when(no, -1).otherwise(0))


def _shape(k: int, kind: str, hit: F.Column) -> F.Column:
    """Is the hit written as such things usually are?"""
    if kind == "secret":
        return _vote(hit.rlike("[0-9]") & hit.rlike("[A-Za-z]"))
    if k >= len(BASE):
        return _vote(hit.rlike(r"[(\[]dot") if kind == "email" else hit.rlike(r"^\([0-9]{3}\) "), F.lit(False))
    if kind == "email":
        return _vote(hit.rlike(r"^[A-Za-z0-9][^@]*@[A-Za-z0-9.-]*[A-Za-z]{2}$"))
    if kind == "ip":
        return _vote(~hit.rlike(r"(?:^|\.)0[0-9]"))
    if kind == "card":
        return _vote(hit.rlike(r"^(?:[0-9]{14,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"))
    return _vote(hit.rlike(r"^\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]+))+$"))


def _check(k: int, kind: str, hit: F.Column) -> F.Column:
    """+1 or -1 where there is a checksum, range, length or alphabet to check, else 0."""
    digits = F.translate(hit, " ().+-", "")
    if kind == "secret":
        # hexadecimal digits say nothing, as digests are written so too
        mixed = hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
        return _vote(mixed, ~hit.rlike("[0-9]") | ~hit.rlike("[A-Za-z]"))
    if k >= len(BASE):
        return _vote(F.lower(hit).rlike(f"(?:{'|'.join(_TOP_DOMAINS)})$"), F.lit(False)) if kind == "email" else _vote(digits.rlike("^[2-9]"))
    if kind == "ip":
        return _vote(hit.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"))
    if kind == "card":
        return _vote(F.char_length(digits).between(14, 19) & F.call_function("luhn_check", digits))
    return _vote(F.char_length(digits).between(10, 15)) if kind == "phone" else F.lit(1)


def _gazetteer(kind: str, hit: F.Column, before: F.Column) -> F.Column:
    """Top-level domains, reserved networks, card issuers, country codes; names that stand before secrets and digests."""
    if kind == "email":
        return _vote(F.lower(F.substring_index(hit, ".", -1)).isin(*_TOP_DOMAINS), F.lit(False))
    if kind == "ip":
        return _vote(F.lit(False), hit.rlike(r"^(?:0|10|127|255|192\.168)\."))
    if kind == "card":
        return _vote(hit.rlike("^[3-6]"))
    if kind == "phone":
        return _vote(hit.rlike("^\\+(?:1|3[0-9]|4[0-9])"), F.lit(False))
    return _vote(before.rlike(_SECRET_NAMES), before.rlike(_PUBLIC_NAMES))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, cands array of (kind, base, start, end, votes, size)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), no_nulls(text_col).alias("text"))
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    given = {"digit": F.col("digit"), "@": F.contains("text", F.lit("@")), "at": F.contains("text", F.lit("(at)")) | F.contains("text", F.lit("[at]"))}
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"h{k}": F.when(given[need], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, (_, p, need) in enumerate(PATTERNS)})
    rows = rows.withColumns({f"g{k}": F.when(F.size(f"h{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, (_, p, _) in enumerate(PATTERNS)}).drop("text", "digit")
    begun = lambda k: F.aggregate(F.arrays_zip(F.transform(F.slice(f"g{k}", F.lit(1), F.size(f"h{k}")), F.char_length).alias("g"), F.transform(f"h{k}", F.char_length).alias("h")), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, x: F.struct((acc["at"] + x["g"] + x["h"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["g"]).alias("out")), lambda acc: acc["out"])
    rows = rows.withColumns({f"b{k}": F.when(F.size(f"h{k}") > 0, begun(k)).otherwise(F.array().cast("array<int>")) for k in range(len(PATTERNS))})

    def made(k: int, kind: str):
        def one(hit: F.Column, i: F.Column) -> F.Column:
            start, before, after = F.get(f"b{k}", i), F.get(f"g{k}", i), F.get(f"g{k}", i + 1)
            near = F.right(before, F.lit(24))
            beside = F.when(before.rlike(r"[\p{L}\p{N}_/]$") | after.rlike(r"^[\p{L}\p{N}_/]"), -1).otherwise(1)
            check = _check(k, kind, hit)
            cue = _vote(near.rlike(_CUES[kind])) if kind == "secret" else _vote(near.rlike(_CUES[kind]), F.lit(False))
            votes = [_shape(k, kind, hit), check, _gazetteer(kind, hit, near), cue, beside]
            return F.struct(F.lit(k).alias("pattern"), F.lit(KINDS.index(kind)).alias("kind"), (F.lit(k < len(BASE)) & (check == 1)).alias("base"), start.alias("start"), (start + F.char_length(hit)).alias("end"), F.array(*[v.cast("int") for v in votes]).alias("votes"), F.least(F.lit(7), F.shiftright(F.char_length(hit), 3)).alias("size"))
        return one

    return rows.select("doc_id", F.concat(*[F.transform(f"h{k}", made(k, kind)) for k, (kind, _, _) in enumerate(PATTERNS)]).alias("cands"))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


#: Prior log-odds that a labeler's vote is worth, and how many rows of its kind that prior weighs as much as.
_PRIOR = (1.5, 3.0, 2.0, 1.5, 1.0)
_STRENGTH = 0.5
_KIND = [KINDS.index(kind) for kind, _, _ in PATTERNS]


def estimate(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 60) -> tuple[list[float], dict]:
    """EM over (pattern, votes, size, count): the posterior of each row, and P(vote | truth) of each labeler by kind.

    Base spans are true. Everything else is latent; labelers start out, and are held by a Dirichlet prior, better than
    chance, so that the two classes cannot change places.
    """
    base = [k < len(BASE) and votes[1] == 1 for k, votes, _, _ in counts]
    post = [1.0 if sure else _sigmoid(sum(w * v for w, v in zip(_PRIOR, votes, strict=True)) - 1) for sure, (_, votes, _, _) in zip(base, counts, strict=True)]
    rows: dict[int, float] = {}
    for pattern, _, _, n in counts:
        rows[_KIND[pattern]] = rows.get(_KIND[pattern], 0.0) + n
    start = {}
    for j, w in enumerate(_PRIOR):
        for y in (0, 1):
            odds = {v: math.exp(w * v * (y - 0.5)) for v in (-1, 0, 1)}
            start |= {(j, y, v): odds[v] / sum(odds.values()) for v in odds}
    table: dict = {}
    for _ in range(rounds):
        prior: dict[int, list[float]] = {}
        table = {(kind, j, y, v): _STRENGTH * (1 + n) * p for kind, n in rows.items() for (j, y, v), p in start.items()}
        for (pattern, votes, _, n), p in zip(counts, post, strict=True):
            a = prior.setdefault(pattern, [1.0, 1.0])
            a[0] += n * (1 - p)
            a[1] += n * p
            for j, v in enumerate(votes):
                table[_KIND[pattern], j, 0, v] += n * (1 - p)
                table[_KIND[pattern], j, 1, v] += n * p
        for kind in rows:
            for j in range(len(LABELERS)):
                for y in (0, 1):
                    total = sum(table[kind, j, y, v] for v in (-1, 0, 1))
                    for v in (-1, 0, 1):
                        table[kind, j, y, v] /= total
        told = [math.log(prior[k][1] / prior[k][0]) + sum(math.log(table[_KIND[k], j, 1, v] / table[_KIND[k], j, 0, v]) for j, v in enumerate(votes)) for k, votes, _, _ in counts]
        post = [1.0 if sure else _sigmoid(z) for sure, z in zip(base, told, strict=True)]
    return post, table


#: Features of the classifier: bias, pattern, each labeler's vote by kind, length class.
_VOTES_AT = 1 + len(PATTERNS)
_SIZES_AT = _VOTES_AT + len(KINDS) * len(LABELERS) * 3


def _features(pattern: int, votes: tuple[int, ...], size: int) -> list[int]:
    """Indices of the features that are on."""
    first = _VOTES_AT + _KIND[pattern] * len(LABELERS) * 3
    return [0, 1 + pattern, *(first + 3 * j + x + 1 for j, x in enumerate(votes)), _SIZES_AT + size]


def train(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 400) -> list[float]:
    """Weights of the span classifier, fitted to the posteriors of :func:`estimate`; kinds weigh alike, however rare."""
    post, _ = estimate(counts)
    w = [0.0] * (_SIZES_AT + 8)
    total: dict[int, float] = {}
    for pattern, _, _, n in counts:
        total[_KIND[pattern]] = total.get(_KIND[pattern], 0.0) + n
    rows = [(_features(*c[:3]), p, c[3] / total[_KIND[c[0]]] / len(total)) for c, p in zip(counts, post, strict=True)]
    for _ in range(rounds):
        grad = [1e-4 * x for x in w]
        for on, p, n in rows:
            error = n * (_sigmoid(sum(w[i] for i in on)) - p)
            for i in on:
                grad[i] += error
        w = [x - 2.0 * g for x, g in zip(w, grad, strict=True)]
    return w


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, spans array of (start, kind, end, base), by start and kind."""
    found = materialize(candidates(docs, id_col, text_col), "pii")
    each = found.select(F.explode("cands").alias("c")).groupBy("c.pattern", "c.votes", "c.size").count()
    counts = [(r["pattern"], tuple(r["votes"]), r["size"], r["count"]) for r in each.collect()]
    w = train(sorted(counts))
    weights = F.array(*[F.lit(x) for x in w])
    v = len(LABELERS)

    def logit(c: F.Column) -> F.Column:
        votes = [F.get(weights, c["kind"] * (3 * v) + F.get(c["votes"], F.lit(j)) + (_VOTES_AT + 3 * j + 1)) for j in range(v)]
        return sum(votes, F.lit(w[0]) + F.get(weights, c["pattern"] + 1) + F.get(weights, c["size"] + _SIZES_AT))

    base = F.filter("cands", lambda c: c["base"])
    free = lambda c: ~F.exists("base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"]))
    added = F.filter("cands", lambda c: ~c["base"] & (logit(c) >= math.log(threshold / (1 - threshold))) & free(c))
    shape = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"))
    return found.withColumn("base", base).select("doc_id", F.array_sort(F.transform(F.concat("base", added), shape)).alias("spans"))


def span_digests(docs: DataFrame) -> DataFrame:
    rows = find_spans(docs)
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select("doc_id", *[count(k) for k in range(4)], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
