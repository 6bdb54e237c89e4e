"""Personal data by weak-supervision aggregation [native].

Patterns propose spans with their place in code points. Labelers vote on each:
the strict format check, a gazetteer of words that announce such data, one of
words that speak against it, the context right beside the span, and a test for
placeholders. Expectation-maximisation over the counts of the vote patterns
estimates how reliable each labeler is for each class, without any labelled
row, and gives every vote pattern a probability. These probabilities, summed
over the corpus, train the span classifier: a naive Bayes model over features
of the span and its surroundings. It decides on the proposed spans that the
strict patterns do not cover; strict spans always stay.

Texts are read with DataFrame functions only. What reaches the driver is a table
of vote patterns (at most kinds x 3^5 rows) and one of feature values (hashed
words, so at most some hundreds), whatever the corpus holds. Both passes are
map-side work with a small partial aggregate; no text is shuffled.

Java's matcher is asked for the same matches as the stated expressions, written
so that long runs of characters take linear time: possessive repeats, and a
start only where a run begins or the last match ended.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from demandspark.llm.common import table

KINDS = ["email", "ip", "card", "phone"]

# Fixed values: (name, kind, strict, expression). Strict ones give the same matches as the contract's.
PATTERNS = [
    ("email", "email", True, r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "card", True, r"[0-9](?:[\x20-]?[0-9]){12,}+"),
    ("phone", "phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email_spelt", "email", False,
     r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({]at[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[({]dot[\])}]|\.) ?[A-Za-z0-9-]{1,63}+){1,5}+"),
    ("phone_national", "phone", False,
     r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
]
#: Words before a span that announce it, in the four languages of the corpus.
ANNOUNCE = {
    "email": "mail|e-mail|email|correo|courriel|contact|kontakt|contacto|write|schreib",
    "ip": r"\bip\b|address|adresse|server|servidor|serveur|host|login|client",
    "card": "card|karte|tarjeta|carte|visa|mastercard|amex|credit|payment",
    "phone": r"phone|tel\b|tel\.|telefon|fono|phone|call|mobile|mobil|fax|whatsapp",
}
#: Words before a span that speak for something else.
AGAINST = r"version|release|section|chapter|isbn|order|invoice|token|sha|commit|serial|page|\bv$|licen[sc]e|build"
#: Placeholders.
PLACEHOLDER = r"^(?:[^@]*@(?:example|test|domain)\.(?:com|org)|(?:0[ -]?)+|127\.0\.0\.1|0\.0\.0\.0|(?:\+?1?[ ().-]*)?(?:123[ ().-]*456[ .-]*7890|(?:555|000)[ ().-]*(?:555|000)[ .-]*\d{4}))$"

LABELERS = ["format", "announced", "against", "beside", "placeholder"]
CONTEXT = 48
WORD_BUCKETS = 64


@dataclass(frozen=True)
class PiiRules:
    rounds: int = 50
    """Rounds of expectation-maximisation."""
    smoothing: float = 1.0
    least: float = 0.5
    """Probability from which a proposed span is kept."""


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0)))
    return (n > 0) & (total % 10 == 0)


def _passes(name: str, x: Column) -> Column:
    """The checks after a match."""
    if name == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return x.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if name == "card":
        d = _digits(x)
        return F.length(d).between(13, 19) & luhn(d)
    if name == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _spans(name: str, kind: str, strict: bool) -> Column:
    """Spans of one pattern, from the matches and the text between them."""
    matches, between = F.col(f"__m_{name}"), F.col(f"__g_{name}")
    n = F.size(matches)
    zipped = F.zip_with(matches, F.slice(between, 1, n), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    zipped = F.zip_with(zipped, F.slice(between, 2, n), lambda z, after: F.struct(z["m"].alias("m"), z["g"].alias("g"), after.alias("after")))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    placed = F.aggregate(
        zipped,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + F.length(z["g"]) + F.length(z["m"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + F.length(z["g"])).alias("start"),
                        (acc["at"] + F.length(z["g"]) + F.length(z["m"])).alias("stop"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.zip_with(
        zipped,
        placed,
        lambda z, p: F.struct(
            F.lit(name).alias("pattern"),
            F.lit(kind).alias("kind"),
            F.lit(KINDS.index(kind)).alias("rank"),
            p["start"].alias("start"),
            p["stop"].alias("stop"),
            z["m"].alias("text"),
            F.right(z["g"], F.lit(CONTEXT)).alias("left"),
            F.left(z["after"], F.lit(CONTEXT)).alias("right"),
            F.coalesce(_passes(name, z["m"]), F.lit(False)).alias("passes"),
            F.lit(strict).alias("strict"),
        ),
    )


def propose(docs: DataFrame, text_col: str, out_col: str = "__spans") -> DataFrame:
    """`docs` with all proposed spans, an array for each row; a null text is empty.

    Loose patterns propose only what no strict span overlaps.
    """
    body = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumns({f"__m_{n}": F.regexp_extract_all(body, F.lit(p), F.lit(0)) for n, _, _, p in PATTERNS})
    none = F.array().cast("array<string>")
    out = out.withColumns(
        {f"__g_{n}": F.when(F.size(f"__m_{n}") > 0, F.split(body, p, -1)).otherwise(none) for n, _, _, p in PATTERNS}
    )
    out = out.withColumns(
        {
            "__strict": F.concat(*[_spans(n, k, s) for n, k, s, _ in PATTERNS if s]),
            "__loose": F.concat(*[_spans(n, k, s) for n, k, s, _ in PATTERNS if not s]),
        }
    )
    sure = F.filter("__strict", lambda s: s["passes"])
    apart = F.filter("__loose", lambda s: ~F.exists(sure, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return out.withColumn(out_col, F.concat("__strict", apart)).drop(
        "__strict", "__loose", *[f"__{x}_{n}" for n, *_ in PATTERNS for x in "mg"]
    )


def votes(s: Column) -> Column:
    """One digit for each labeler: 0 against, 1 silent, 2 for."""
    left = F.lower(s["left"])
    announced = F.lit(False)
    for kind, words in ANNOUNCE.items():
        announced = announced | ((s["kind"] == kind) & left.rlike(words))
    before, after = F.right(s["left"], F.lit(1)), F.left(s["right"], F.lit(1))
    glued = before.rlike(r"[\p{L}\p{N}_=/#-]") | after.rlike(r"[\p{L}\p{N}_@/#-]")
    apart = (before == "") | before.rlike(r"[\s\p{P}]")
    return F.concat(
        F.when(~s["strict"], "1").when(s["passes"], "2").otherwise("0"),
        F.when(announced, "2").otherwise("1"),
        F.when(left.rlike(AGAINST), "0").otherwise("1"),
        F.when(glued, "0").when(apart, "2").otherwise("1"),
        F.when(s["text"].rlike(PLACEHOLDER), "0").otherwise("1"),
    )


def features(s: Column) -> Column:
    """Names of the feature values of a span."""
    before, after = F.right(s["left"], F.lit(1)), F.left(s["right"], F.lit(1))

    def shape(c: Column) -> Column:
        return (
            F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike(r"[\p{L}]"), "letter")
            .when(c.rlike(r"[\p{N}]"), "digit").otherwise("mark")
        )

    word = F.regexp_extract(F.lower(s["left"]), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    return F.array(
        F.concat_ws("|", F.lit("p"), s["pattern"], s["passes"].cast("string")),
        F.concat_ws("|", F.lit("n"), s["pattern"], F.least(F.length(_digits(s["text"])), F.lit(20)).cast("string")),
        F.concat_ws("|", F.lit("b"), shape(before)),
        F.concat_ws("|", F.lit("a"), shape(after)),
        F.concat_ws("|", F.lit("w"), F.pmod(F.xxhash64(word), F.lit(WORD_BUCKETS)).cast("string")),
    )


# -- the label model ----------------------------------------------------------------------
def estimate(patterns: Iterable[tuple[str, str, int]], rules: PiiRules = PiiRules()) -> dict[tuple[str, str], float]:
    """Probability that a span is personal data, for each (pattern name, votes).

    Expectation-maximisation of a two-class model in which labelers vote
    independently given the class, started from trust in the labelers: a vote
    is right three times out of four.
    """
    seen = [(name, v, n) for name, v, n in sorted(patterns)]
    share = {name: 0.5 for name, _, _ in seen}
    trust = [[{0: 0.4, 1: 0.4, 2: 0.2}, {0: 0.1, 1: 0.4, 2: 0.5}] for _ in LABELERS]
    out: dict[tuple[str, str], float] = {}
    for _ in range(rules.rounds):
        out = {}
        for name, v, _ in seen:
            odds = math.log(share[name] / (1 - share[name]))
            odds += sum(math.log(trust[i][1][int(x)] / trust[i][0][int(x)]) for i, x in enumerate(v))
            out[name, v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        for name in share:
            mine = [(out[k, v], n) for k, v, n in seen if k == name]
            total = sum(n for _, n in mine)
            share[name] = (sum(p * n for p, n in mine) + rules.smoothing) / (total + 2 * rules.smoothing)
        for i in range(len(LABELERS)):
            for c in (0, 1):
                weight = {x: rules.smoothing * start for x, start in ((0, 0.4 - 0.3 * c), (1, 0.4), (2, 0.2 + 0.3 * c))}
                for name, v, n in seen:
                    p = out[name, v]
                    weight[int(v[i])] += n * (p if c else 1 - p)
                total = sum(weight.values())
                trust[i][c] = {x: w / total for x, w in weight.items()}
    return out


@dataclass(frozen=True)
class SpanClassifier:
    weights: dict[str, float]
    """Log odds of each feature value."""
    bias: float
    least: float

    def keeps(self, s: Column) -> Column:
        table = F.from_json(F.lit(json.dumps(self.weights)), "map<string,double>")
        total = F.aggregate(features(s), F.lit(self.bias), lambda acc, f: acc + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return total >= math.log(self.least / (1 - self.least))


def train(docs: DataFrame, text_col: str = "text", rules: PiiRules = PiiRules()) -> SpanClassifier:
    """Learns from the votes on all proposed spans of the texts; no labels are used."""
    # An outer explode: for a plain one the optimizer would evaluate the spans once more to test for empty arrays.
    spans = propose(docs.select(F.col(f"`{text_col}`").alias("text")), "text").select(F.explode_outer("__spans").alias("s"))
    spans = spans.where(F.col("s").isNotNull())
    counted = (
        spans.select(F.col("s.pattern").alias("pattern"), votes(F.col("s")).alias("votes"), F.explode(features(F.col("s"))).alias("feature"))
        .groupBy("pattern", "votes", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    # Every span has one feature of the first group, so these count spans.
    found: dict[tuple[str, str], int] = {}
    for r in counted:
        if r.feature.startswith("p|"):
            found[r.pattern, r.votes] = found.get((r.pattern, r.votes), 0) + r.n
    sure = estimate([(k, v, n) for (k, v), n in found.items()], rules)
    good = sum(sure[k] * n for k, n in found.items()) + rules.smoothing
    bad = sum((1 - sure[k]) * n for k, n in found.items()) + rules.smoothing
    hits: dict[str, list[float]] = {}
    for r in sorted(counted, key=lambda r: (r.feature, r.pattern, r.votes)):
        both = hits.setdefault(r.feature, [0.0, 0.0])
        both[1] += sure[r.pattern, r.votes] * r.n
        both[0] += (1 - sure[r.pattern, r.votes]) * r.n
    # Smoothed in the ratio of the classes: a value that was never seen says nothing.
    a, b = rules.smoothing * good / (good + bad), rules.smoothing * bad / (good + bad)
    weights = {f: math.log((p + a) / (q + b)) - math.log(good / bad) for f, (q, p) in hits.items()}
    return SpanClassifier(weights, math.log(good / bad), rules.least)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def find_personal_data(
    docs: DataFrame, text_col: str = "text", model: SpanClassifier | None = None, base_col: str = "base", spans_col: str = "spans"
) -> DataFrame:
    """`docs` with two arrays of (rank, start, stop, kind, text): the strict spans, and all (they replace columns of the names).

    Spans are in the order of kinds, then starts; places are code points, ends
    exclusive. An added span never overlaps a strict one. Null texts have none.
    """
    model = model or train(docs, text_col)
    keep = [c for c in docs.columns if c not in (base_col, spans_col)]
    found = propose(docs.select(*[F.col(f"`{c}`") for c in keep]), text_col)
    slim = lambda s: F.struct(*[s[c].alias(c) for c in ("rank", "start", "stop", "kind", "text")])
    found = found.withColumn("__base", F.array_sort(F.transform(F.filter("__spans", lambda s: s["strict"] & s["passes"]), slim)))
    rest = F.filter("__spans", lambda s: ~(s["strict"] & s["passes"]) & model.keeps(s))
    apart = F.filter(
        F.transform(rest, slim),
        lambda s: ~F.exists("__base", lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    found = found.withColumn("__all", F.array_sort(F.concat("__base", apart)))
    return found.select(*[F.col(f"`{c}`") for c in keep], F.col("__base").alias(base_col), F.col("__all").alias(spans_col))


def redact(found: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The text with each span replaced by its kind in brackets; overlapping spans give one mark."""
    ordered = F.array_sort(F.transform(F.col(spans_col), lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    text = F.col(f"`{text_col}`")
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(
                s["stop"].alias("at"),
                F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(text.isNull(), text).otherwise(done))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_personal_data(docs)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
