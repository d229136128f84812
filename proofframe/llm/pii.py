"""Personal data by weak supervision, in DataFrame functions alone.

Spans of four base kinds are found by fixed patterns and checks. Beside them, looser patterns propose candidate spans
(written-out e-mail addresses, groups of digits, assigned values and long runs of letters and digits, account numbers),
loose enough that labelers disagree and most candidates are none; candidates that overlap a base span are left out. On
each one labelers vote: a strict pattern, a gazetteer that holds a term of the candidate, words in the context before it,
and its shape. Votes are counted over all documents by pattern, a table of bounded size; expectation-maximisation on that
table estimates each labeler's reliability for each kind without labels and gives each vote pattern a probability. A logistic classifier is trained on those
probabilities; its features are the kind, the votes, and what no labeler sees: length, share of digits, variety of
characters and what stands behind. Candidates that it accepts are added.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_text

#: The base kinds, in the order of output. A match never begins inside a run that an earlier place would have taken,
#: so the look-behinds change no match; possessive quantifiers keep the time linear in long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched for a base kind.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: Candidate kinds: a loose pattern and a hint of it, then what labelers look for: a strict pattern, the part of the
#: candidate or of the text before it (in lower case) that the gazetteer is asked for, words of the context.
EXTRA = {
    "email_written": {
        "loose": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++",
        "hint": r"[\[(\x20](?:at|AT)[\])\x20].*[\[(\x20](?:dot|DOT)[\])\x20]",
        "strict": r"^[A-Za-z0-9._%+-]+\x20?[\[(]at[\])]",
        "term": ("hit", r"([a-z]+)$"),
        "context": r"(?i)(?:mail|contact|write|reach)",
    },
    "phone_national": {
        "loose": r"(?<![0-9+)\x20.-])\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}(?![0-9])|(?<=[^0-9+)(.-]\x20)\(?[0-9]{2,5}\)?(?:[\x20.-][0-9]{2,5}){1,4}(?![0-9])",
        "hint": r"[0-9]{2}\)?[\x20.-][0-9]{2}",
        "strict": r"^(?:\([2-9][0-9]{2}\)\x20|[2-9][0-9]{2}[.-])[0-9]{3}[.-][0-9]{4}$",
        "term": ("before", r"([a-z]+)[^a-z]{0,3}$"),
        "context": r"(?i)(?:phone|call|tel|mobile|fax|dial)",
    },
    "secret": {
        "loose": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}|(?<=[=:][\x20]{0,2}[\"']{0,1})(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_.!@#$%^&*~-]{6,}+",
        "hint": r"[A-Za-z0-9+/_-]{16}|[=:]\x20{0,2}[\"']?[A-Za-z0-9+/_.!@#$%^&*~-]{6}",
        "strict": r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,}|[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{64}|(?=[^0-9]*[0-9])(?=[^A-Z]*[A-Z])[A-Za-z0-9+/]{40,}={0,2})$",
        "term": ("before", r"([a-z]+)[^a-z]{0,6}$"),
        "context": r"(?i)(?:key|token|secret|passw|aws|api|auth|credential)[^=:]{0,24}[=:]",
    },
    "iban": {
        "loose": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,8}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "hint": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
        "strict": r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){3,7}(?:\x20?[0-9]{1,3})?$",
        "term": ("hit", r"^([a-z]{2})"),
        "context": r"(?i)(?:iban|account|bank|konto)",
    },
}
#: The gazetteer: terms of each kind.
GAZETTEER = {
    "email_written": ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at"],
    "phone_national": ["phone", "call", "tel", "telephone", "mobile", "cell", "fax", "dial", "home", "office", "work", "t", "f", "m"],
    "secret": ["token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "access", "private", "signature"],
    "iban": ["ad", "at", "be", "bg", "ch", "cy", "cz", "de", "dk", "ee", "es", "fi", "fr", "gb", "gr", "hr", "hu", "ie", "is", "it", "li", "lt", "lu", "lv", "mc", "mt", "nl", "no", "pl", "pt", "ro", "se", "si", "sk"],
}
LABELERS = ("strict", "gazetteer", "context", "shape")
#: What the classifier sees beside kind and votes, and the values of each.
TRAITS = {"length": 3, "digits": 3, "variety": 3, "closed": 2}
CHUNK = 256  # matches whose places are summed up at a time
CONTEXT = 40
PRIOR = 0.25
START, WEIGHT = (0.8, 0.2), 10  # chances to vote on true and false spans at first, and of how many spans these count as
ROUNDS = 50


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans_of(text: Column, pattern: str, hint: str) -> Column:
    """Array of (start, end, hit, before, after) of a pattern's matches: code points, end exclusive, and what stands
    around.

    The text is split at the matches; starts are running sums of the pieces' and matches' lengths. Sums run over CHUNK
    matches at a time and then over chunks, so the cost is near to linear in the matches of a text."""
    kind = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.length(x["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["piece"], F.lit(CONTEXT)).alias("before"), F.left(x["next"], F.lit(8)).alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def chunks(zipped: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int"))
        zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(zipped, i * CHUNK + 1, CHUNK), zero, step))

    def joined(parts: Column) -> Column:
        bases = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + p["at"])))
        moved = F.zip_with(parts, F.slice(bases, 1, F.size(parts)), lambda p, base: F.transform(p["out"], lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end"), s["hit"].alias("hit"), s["before"].alias("before"), s["after"].alias("after"))))
        return F.flatten(moved)

    def whole(zipped: Column) -> Column:
        return F.when(F.size(zipped) > 0, bound(chunks(zipped), joined)).otherwise(none)

    def zipped(both: Column) -> Column:
        n = F.size(both["hits"])
        return F.arrays_zip(F.slice(both["pieces"], 1, n).alias("piece"), both["hits"].alias("hit"), F.slice(both["pieces"], 2, n).alias("next"))

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("pieces"))
    found = bound(bound(both, zipped), whole)
    return F.when(F.regexp_instr(text, F.lit(hint)) > 0, found).otherwise(none)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def sound(kind: str, hit: Column) -> Column:
    """Whether a base match passes its kind's check."""
    if kind == "ip":
        part = F.split(hit, r"\.")
        return F.forall(part, lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.length(digits(hit)).between(16, 19) & F.call_function("luhn_check", digits(hit))
    if kind == "phone":
        return F.length(digits(hit)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    def of(kind: str) -> Column:
        return F.filter(spans_of(text, BASE[kind], HINT[kind]), lambda s: sound(kind, s["hit"]))

    return {k: of(k) for k in BASE}


def shaped(kind: str, hit: Column, digit: Column, variety: Column) -> Column:
    """The labeler of shapes: letters and digits mixed as in a key, or as many digits as a number has."""
    n = F.length(hit)
    if kind == "secret":
        return (n >= 12) & (variety >= 8) & (((digit > 0) & (digit < n)) | hit.rlike("^[A-Z0-9]{16,}$"))
    if kind == "phone_national":
        return digit.between(9, 11)
    if kind == "iban":
        return digit * 2 >= n
    return variety >= 6


def candidates(text: Column, base: Column) -> Column:
    """Array of (kind, start, end, votes, traits) of all candidate spans clear of the base spans (a struct of arrays)."""

    def of(kind: str) -> Column:
        how = EXTRA[kind]

        def clear(s: Column) -> Column:
            ok = F.lit(True)
            for k in BASE:
                ok = ok & ~F.exists(base[k], lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return ok

        def voted(s: Column) -> Column:
            side, term = how["term"]
            digit, n = F.length(digits(s["hit"])), F.length(s["hit"])
            variety = F.size(F.array_distinct(F.split(s["hit"], "")))
            votes = (
                s["hit"].rlike(how["strict"]),
                F.regexp_extract(F.lower(s[side]), term, 1).isin(GAZETTEER[kind]),
                s["before"].rlike(how["context"]),
                shaped(kind, s["hit"], digit, variety),
            )
            traits = (
                F.when(n < 16, 0).when(n < 32, 1).otherwise(2),
                F.when(digit == 0, 0).when(digit * 2 <= n, 1).otherwise(2),
                F.when(variety < 6, 0).when(variety < 12, 1).otherwise(2),
                F.when(s["after"].rlike(r"^(?:$|[\s\"').,;:!?])"), 1).otherwise(0),
            )
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), *(v.cast("int").alias(n) for v, n in zip(votes, LABELERS, strict=True)), *(v.alias(n) for v, n in zip(traits, TRAITS, strict=True)))

        return F.transform(F.filter(spans_of(text, how["loose"], how["hint"]), clear), voted)

    return F.concat(*(of(k) for k in EXTRA))


def found_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns in keep (doc_id and text), base (kind to array of start, end) and cand (see candidates)."""
    base = F.struct(*(F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias(k) for k, c in base_spans(F.col("text")).items()))
    rows = docs.select(*keep, base.alias("base"))
    return rows.select(*keep, "base", candidates(F.col("text"), F.col("base")).alias("cand"))


def vote_counts(docs: DataFrame) -> dict[tuple, int]:
    """(kind, votes..., traits...) to the number of candidates in all documents: at most kinds x 2^labelers x traits' values rows."""
    names = ["kind", *LABELERS, *TRAITS]
    rows = found_spans(docs_text(docs), "doc_id", "text").select(F.explode("cand").alias("c")).groupBy(*(F.col(f"c.{n}") for n in names)).count()
    return {tuple(r[n] for n in names): r["count"] for r in rows.collect()}


def by_votes(counts: dict[tuple, int]) -> dict[tuple, int]:
    out: dict[tuple, int] = {}
    for p, n in counts.items():
        key = p[: 1 + len(LABELERS)]
        out[key] = out.get(key, 0) + n
    return out


def estimate(counts: dict[tuple, int]) -> tuple[dict[str, float], dict[str, list[tuple[float, float]]]]:
    """Prior of each kind, and for each kind each labeler's chance to vote on true and on false spans, by EM.
    counts: (kind, votes...) to numbers.

    Labelers start as better than chance; a pseudo-count of START's weight keeps that where a kind has little data. A
    kind's prior has a pseudo-count of one true span in four, so it falls where a kind has few candidates or none."""
    prior = dict.fromkeys(EXTRA, PRIOR)
    rates = {k: [START] * len(LABELERS) for k in EXTRA}
    for _ in range(ROUNDS):
        true = {p: posterior(p, prior, rates) for p in counts}
        for k in EXTRA:
            own = [(p, c, c * true[p]) for p, c in counts.items() if p[0] == k]
            n, yes = sum(c for _, c, _ in own), sum(t for *_, t in own)
            prior[k] = (1 + yes) / (4 + n)
            new = []
            for i in range(len(LABELERS)):
                hit = sum(t * p[1 + i] for p, _, t in own)
                false = sum((c - t) * p[1 + i] for p, c, t in own)
                new.append(((hit + WEIGHT * START[0]) / (yes + WEIGHT), (false + WEIGHT * START[1]) / (n - yes + WEIGHT)))
            rates[k] = new
    return prior, rates


def posterior(pattern: tuple, prior: dict[str, float], rates: dict[str, list[tuple[float, float]]]) -> float:
    yes, no = prior[pattern[0]], 1 - prior[pattern[0]]
    for v, (hit, false) in zip(pattern[1 : 1 + len(LABELERS)], rates[pattern[0]], strict=True):
        yes *= hit if v else 1 - hit
        no *= false if v else 1 - false
    return yes / (yes + no)


def classifier(counts: dict[tuple, int]) -> dict[str, float]:
    """Weights of the span classifier: one for each kind, labeler and value of a trait, and one for two votes or more.
    Logistic regression by gradient steps on all patterns of votes and on the counted ones of votes and traits, each
    weighed by the logarithm of its count and aimed at its votes' probability."""
    prior, rates = estimate(by_votes(counts))
    names = [*EXTRA, *LABELERS, "several", *(f"{t}{v}" for t, n in TRAITS.items() for v in range(n))]
    weights = dict.fromkeys(names, 0.0)
    patterns = {(k, *v): 0 for k in EXTRA for v in product((0, 1), repeat=len(LABELERS))} | counts
    rows = [(features(p), posterior(p, prior, rates), 1 + math.log1p(n)) for p, n in patterns.items()]
    scale = sum(c for _, _, c in rows)
    for _ in range(2000):
        slope = {n: 1e-3 * w for n, w in weights.items()}
        for on, target, c in rows:
            p = 1 / (1 + math.exp(-sum(weights[n] for n in on)))
            for n in on:
                slope[n] += c * (p - target) / scale
        for n in names:
            weights[n] -= 2.0 * slope[n]
    return weights


def features(pattern: tuple) -> list[str]:
    """Names of the weights that a pattern (kind, votes..., and traits or none) switches on."""
    votes, traits = pattern[1 : 1 + len(LABELERS)], pattern[1 + len(LABELERS) :]
    on = [n for n, v in zip(LABELERS, votes, strict=True) if v]
    return [pattern[0], *on, *(["several"] if len(on) > 1 else []), *(f"{t}{v}" for t, v in zip(TRAITS, traits, strict=False))]


def accepted(c: Column, weights: dict[str, float]) -> Column:
    kind = F.create_map(*(F.lit(x) for k in EXTRA for x in (k, float(weights[k]))))
    votes = sum((c[n] for n in LABELERS[1:]), c[LABELERS[0]])
    z = F.element_at(kind, c["kind"]) + sum((F.lit(float(weights[n])) * c[n] for n in LABELERS), F.lit(0.0))
    for t, n in TRAITS.items():
        z = z + F.element_at(F.array(*(F.lit(float(weights[f"{t}{v}"])) for v in range(n))), c[t] + 1)
    return z + F.when(votes > 1, F.lit(float(weights["several"]))).otherwise(0.0) >= 0


def detect(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, text, base (kind to array of spans) and extra (array of kind, start, end) of every whole text.

    Null texts are empty and hold nothing; repeated rows stay; other columns are not read; an empty table gives no
    rows."""
    rows = found_spans(docs_text(docs), "doc_id", "text")
    extra = F.transform(F.filter("cand", lambda c: accepted(c, weights)), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "text", "base", extra.alias("extra"))


def train(docs: DataFrame) -> dict[str, float]:
    return classifier(vote_counts(docs))


def listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digests(docs: DataFrame) -> DataFrame:
    """Counts and spans of every document; see detect."""
    found = detect(docs, train(docs))
    base = F.concat(*(listed(k, F.col("base")[k]) for k in BASE))
    extra = F.transform(F.array_sort("extra"), lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string")))
    sizes = [F.size(F.col("base")[k]).cast("long") for k in BASE]
    return found.select(
        "doc_id",
        *(n.alias(f"n_{k}") for n, k in zip(sizes, BASE, strict=True)),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"),
        F.size("extra").cast("long").alias("n_extra"),
        (sum(sizes[1:], sizes[0]) + F.size("extra")).alias("n_spans"),
    )


def placed(kind: Column | None, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), (s["kind"] if kind is None else kind).alias("kind")))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by its kind in angle brackets; null texts stay null, all columns stay,
    whatever their names; repeated rows stay; an empty table gives no rows.

    Of overlapping spans the first to begin is replaced, and what reaches beyond it goes with it."""
    weights = train(docs)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    found = found_spans(docs.select(row, F.coalesce("text", F.lit("")).alias("text")), "row", "text")
    span = "struct<start:int,end:int,kind:string>"
    every = F.concat(*(placed(F.lit(k), F.col("base")[k]) for k in BASE), placed(None, F.filter("cand", lambda c: accepted(c, weights))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))

    out = found.select("row", "text", F.array_sort(every.cast(f"array<{span}>")).alias("spans"))
    clean = F.when(F.size("spans") > 0, F.aggregate("spans", zero, step, finish)).otherwise(F.col("row.text"))
    out = out.select("row", clean.alias("text"))
    return out.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
