"""Secret scan: base patterns, and character Markov models compared by log-likelihood ratio; no Python on the executors.

The models count transitions between neighbouring characters. The labelled samples come from all
documents: values that a base pattern marks are random strings, other tokens of the same alphabet
and length are ordinary identifiers, but for those that change between digits and letters or from lower
to upper case too often to be one: they are only judged, or secrets would vouch for themselves. Each
random sample trains the model of the smallest of the ``CLASSES`` that holds its characters; until a class has
samples, its model is the even choice that all of them start from. Counting combines before the shuffle
and ends in at most 4 * 128 * 128 numbers. A token that no base span
touches becomes a span when the mean log-likelihood ratio of its transitions, of any random model
against the ordinary one, is at least ``MIN_MEAN`` and it holds a letter. A token without lower-case letters is read in
lower case: its case tells nothing. Texts are scanned once; spans and tokens are written and read again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.llm.common import lower_ascii, save

# The base patterns, in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Tokens that the models learn from and judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Lowest mean log-likelihood ratio per transition, in nats, of a secret.
MIN_MEAN = 0.5
SMOOTHING = 0.5
#: Weight of the single-character frequencies, in transitions. It is large because secrets that no base
#: pattern marks are among the ordinary tokens and must not vouch for their own transitions.
BACK_OFF = 200.0
#: Places where the class of characters changes, and their largest share in a token that the ordinary model learns from.
CHANGE = r"[a-z](?=[A-Z0-9])|[A-Z](?=[0-9])|[0-9](?=[A-Za-z])"
MAX_CHANGES = 0.2
#: Alphabets of random strings, each in the next one, after the lower case of one-case tokens.
CLASSES = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", ALPHABET)
#: Share of an even choice in the ordinary model, so that no unseen character decides alone.
UNIFORM = 0.05
#: The same in a random model, for characters outside its class.
OUTSIDE = 0.001
_SPANS = "array<struct<start:long,kind:int,end:long,value:string>>"


def _matches(text: Column, pattern: str, kind: int) -> Column:
    """All leftmost non-overlapping matches with their places in code points, end exclusive.

    What lies between the matches comes from splitting at them; adding up the lengths of both gives
    the places.
    """
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value")
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPANS).alias("spans"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.coalesce(F.length(pair["value"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["value"].alias("value")
        )
        spans = F.when(pair["value"].isNull(), state["spans"]).otherwise(F.concat(state["spans"], F.array(span)))
        return F.struct(end.alias("at"), spans.cast(_SPANS).alias("spans"))

    found = F.aggregate(pairs, start, step, lambda state: state["spans"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(_SPANS))


def _scanned(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, base spans and the tokens that no base span touches."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    assign = F.filter(
        _matches(text, ASSIGN, 0),
        lambda span: F.length(F.regexp_extract(span["value"], ASSIGN, 2)) >= MIN_ASSIGN,
    )
    # Both are runs that end where their alphabet does, so a lower bound in the pattern changes nothing.
    access = _matches(text, f"AKIA[A-Z0-9]{{{MIN_ACCESS - 4},}}", 1)
    digits = _matches(text, f"[0-9a-f]{{{MIN_HEX},}}", 2)
    return documents.select(
        F.col(id_column).alias("doc_id"),
        F.concat(assign, access, digits).alias("base"),
        _matches(text, TOKEN, 3).alias("tokens"),
    ).select(
        "doc_id",
        "base",
        F.when(
            F.size("tokens") > 0,
            F.filter(
                "tokens",
                lambda token: ~F.exists(
                    "base", lambda span: (span["start"] < token["end"]) & (token["start"] < span["end"])
                ),
            ),
        ).otherwise(F.col("tokens")).alias("tokens"),
    )


def _as_read(value: Column) -> Column:
    """One-case values in lower case."""
    return F.when(F.rlike(value, F.lit("[a-z]")), value).otherwise(lower_ascii(value))


def _transitions(value: Column) -> Column:
    """Codes of neighbouring characters: 128 * first + second; one-case values in lower case."""
    characters = F.split(_as_read(value), "")
    n = F.size(characters)
    return F.zip_with(
        F.slice(characters, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(characters, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.ascii(a) * 128 + F.ascii(b),
    )


def _plain(token: Column) -> Column:
    """Whether a token has few enough changes of class to be an ordinary identifier."""
    changes = F.size(F.regexp_extract_all(token["value"], F.lit(CHANGE), F.lit(0)))
    return changes <= MAX_CHANGES * (F.length(token["value"]) - 1)


def train(scanned: DataFrame) -> list[list[float]]:
    """Log-likelihood ratios of every transition code against ordinary identifiers, one list per random model.

    Without any ordinary token to learn from there is no list and nothing is found.
    """
    span = F.col("span")
    # What a pattern prescribes says nothing about random characters.
    value = (
        F.when(span["kind"] == 0, F.regexp_extract(span["value"], ASSIGN, 2))
        .when(span["kind"] == 1, F.substring(span["value"], 5, 1 << 30))
        .otherwise(span["value"])
    )
    read = _as_read(value)
    of_class = F.when(span["kind"] == 3, -1)
    for i, characters in enumerate(CLASSES[:-1]):
        of_class = of_class.when(F.length(F.translate(read, characters, "")) == 0, i)
    counts = (
        scanned.select(F.explode(F.concat("base", F.filter("tokens", _plain))).alias("span"))
        .select(of_class.otherwise(len(CLASSES) - 1).alias("class"), F.explode(_transitions(value)).alias("code"))
        .groupBy("class", "code")
        .count()
        .collect()  # at most 4 * 128 * 128 rows
    )
    samples: dict[int, dict[int, int]] = {i: {} for i in range(-1, len(CLASSES))}
    for row in counts:
        samples[row["class"]][row["code"]] = row["count"]
    if not samples[-1]:
        return []
    codes = [ord(c) for c in ALPHABET]
    ordinary = _log_probabilities(samples[-1], codes)
    out = []
    for i, characters in enumerate(CLASSES):
        logs = _random(samples[i], characters, codes)
        ratios = [0.0] * (128 * 128)
        for code in logs:
            ratios[code] = round(logs[code] - ordinary[code], 4)
        out.append(ratios)
    return out


def _log_probabilities(counts: dict[int, int], codes: list[int]) -> dict[int, float]:
    """Logarithm of the probability of each transition, backed off to that of its second character.

    A first character that was hardly seen says little about the next one; the frequency of the next
    one in the whole sample then decides, and a uniform choice where that was not seen either.
    """
    single = {b: SMOOTHING + sum(counts.get(a * 128 + b, 0) for a in codes) for b in codes}
    everything = sum(single.values())
    out = {}
    for a in codes:
        total = sum(counts.get(a * 128 + b, 0) for b in codes)
        for b in codes:
            expected = BACK_OFF * single[b] / everything
            learned = (counts.get(a * 128 + b, 0) + expected) / (total + BACK_OFF)
            out[a * 128 + b] = math.log((1 - UNIFORM) * learned + UNIFORM / len(codes))
    return out


def _random(counts: dict[int, int], characters: str, codes: list[int]) -> dict[int, float]:
    """Logarithm of the probability of each transition in random strings over ``characters``.

    Learned from the counts; an even choice of the characters counts like ``BACK_OFF`` transitions.
    """
    inside = [ord(c) for c in characters]
    out = {}
    for a in codes:
        total = sum(counts.get(a * 128 + b, 0) for b in inside) + BACK_OFF
        for b in codes:
            learned = (counts.get(a * 128 + b, 0) + BACK_OFF / len(inside)) / total if b in inside else 0.0
            out[a * 128 + b] = math.log((1 - OUTSIDE) * learned + OUTSIDE / len(codes))
    return out


def _rendered(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def scan_secrets(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_mean: float = MIN_MEAN
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Spans are ``kind:start:end`` in code points, ordered by start and kind. Matches of a base pattern
    that are too short are dropped after matching, so they still use up their characters. A null text
    counts as empty; without a span the list is an empty string. Repeated rows give repeated results
    and an empty table none. Other columns are not read.
    """
    scanned = save(_scanned(documents, id_column, text_column), "secret-tokens")
    models = [F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>") for ratios in train(scanned)]

    def secret(token: Column) -> Column:
        steps = _transitions(token["value"])
        least = min_mean * (F.length(token["value"]) - 1)
        found = F.lit(False)
        for ratios in models:
            total = F.aggregate(steps, F.lit(0.0), lambda sum_, code: sum_ + F.get(ratios, code))
            found = found | (total >= least)
        # Random digits look like any account or telephone number.
        return found & F.rlike(token["value"], F.lit("[A-Za-z]"))

    judged = scanned.withColumn("added", F.filter("tokens", secret))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return judged.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(_rendered(F.col("base")), 256).alias("base_sha256"),
        _rendered(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )
