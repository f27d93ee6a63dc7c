"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .shared import by_batch, stored, table

WORD = re.compile(r"[^\W_]+")
#: Labelled rows of each class that the log-odds are learned from, and features kept: bounds of the model.
SAMPLE_ROWS, MODEL_FEATURES = 4_000, 20_000
#: Prior counts per feature and class; least contexts and least log-odds (so many deviations below the estimate) of a toxic
#: feature; score of any other token.
PRIOR, LEAST_CONTEXTS, LEAST_ODDS, DEVIATIONS, OTHER = 0.5, 3, 2.0, 2.0, -0.25
#: Largest score of a token, tokens whose score a worker remembers.
LARGEST, REMEMBERED = 6.0, 500_000
#: Lengths of the beginnings and endings of words that count as features beside whole words.
AFFIXES = (4, 5, 6)
#: A document is toxic from this score on.
TOXIC_FROM = 0.7


def tokens_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def features_of(token: str) -> list[str]:
    """The word, and its beginnings and endings: inflected toxic words share them."""
    long = [n for n in AFFIXES if n < len(token)]
    return ["=" + token, *("<" + token[:n] for n in long), *(">" + token[-n:] for n in long)]


class TokenScores(dict):
    """Token -> largest log-odds of its features, zero for none; forgets all once it holds REMEMBERED tokens."""

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights

    def __missing__(self, token: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = value = max((self.weights.get(f, 0.0) for f in features_of(token)), default=0.0)
        return value


def learn(docs: DataFrame, labels: DataFrame) -> dict:
    """The model {"weights": feature -> log-odds, "rate": decay of chance scores} from labelled rows.

    Log-odds of toxic against clean text with a Dirichlet prior, DEVIATIONS below the estimate, kept from LEAST_ODDS
    on. A token counts once per context (the words beside it), so copies of a text count once. SAMPLE_ROWS rows of
    each class, those with the smallest hash of their doc_id, bound the work. Rows without doc_id or label teach nothing;
    without labels the model is empty and every score is zero.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"))
    chosen = None
    for kind in (0, 1):
        some = labels.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen = some if chosen is None else chosen.unionByName(some)
    # At most 2 * SAMPLE_ROWS small rows: small enough to send to every task.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def contexts(batch: pa.RecordBatch) -> dict:
        rows = set()
        for text, toxic in zip(*(batch.column(n).to_pylist() for n in ("text", "toxic")), strict=True):
            words = ["", *tokens_of(text), ""]
            rows.update((w, xxh3_64_intdigest(f"{a} {b}") >> 1, int(toxic))
                        for a, w, b in zip(words, words[1:], words[2:], strict=False))
        token, context, toxic = zip(*rows, strict=True) if rows else ((), (), ())
        return {"token": token, "context": context, "toxic": toxic}

    seen = by_batch(sample, contexts, "token string, context long, toxic int").distinct()
    counted = stored(seen.groupBy("token").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")),
                     "toxic-tokens")
    all_t, all_c = (v or 0 for v in counted.agg(F.sum("t"), F.sum("c")).first())
    word = F.col("token")
    affixes = [F.when(F.length(word) > n, F.concat(F.lit(mark), part(n))) for n in AFFIXES for mark, part in
               (("<", lambda n: F.left(word, F.lit(n))), (">", lambda n: F.right(word, F.lit(n))))]
    features = counted.select("t", "c", F.explode(F.array_compact(F.array(F.concat(F.lit("="), word), *affixes)))
                              .alias("feature")).groupBy("feature").agg(F.sum("t").alias("t"), F.max("t").alias("most"), F.sum("c").alias("c"))
    # An affix needs more than the one word that it is mostly seen in.
    features = features.withColumn("t", F.col("t") - F.when(F.col("feature").startswith("="), 0).otherwise(F.col("most")))
    likely = features.where(F.col("t") >= LEAST_CONTEXTS).withColumns(
        {"odds": log_odds(F.col("t"), F.col("c"), all_t, all_c)}).where(F.col("odds") >= LEAST_ODDS).orderBy(
        F.desc("odds"), "feature").limit(MODEL_FEATURES).collect()
    wanted = {r.feature for r in likely}

    def documents(batch: pa.RecordBatch) -> dict:
        rows = set()
        for text in batch.column("text").to_pylist():
            words = tokens_of(text)
            kin = min((xxh3_64_intdigest(f"{a} {b}") >> 1 for a, b in zip(words, words[1:], strict=False)), default=0)
            rows.update((f, kin) for w in set(words) for f in features_of(w) if f in wanted)
        feature, kin = zip(*rows, strict=True) if rows else ((), ())
        return {"feature": feature, "kin": kin}

    # A word that one text repeats has many contexts but one document, and texts with the same least word pair are
    # mostly copies, changed ones too: each counts once.
    texts = by_batch(sample.where("toxic = 1"), documents, "feature string, kin long").distinct().groupBy(
        "feature").count()
    support = dict(texts.collect()) if wanted else {}
    counts = {r.feature: (min(r.t, support.get(r.feature, 0)), r.c) for r in likely}
    sure = {f: (log_odds_of(t, c, all_t, all_c), c) for f, (t, c) in counts.items() if t >= LEAST_CONTEXTS}
    weights = {f: min(LARGEST, w) for f, (w, _) in sure.items() if w >= LEAST_ODDS}
    return {"weights": weights, "rate": chance_rate([(w, sure[f][1]) for f, w in weights.items()], all_c)}


def log_odds(t: Column, c: Column, all_t: int, all_c: int) -> Column:
    t0, c0 = t + PRIOR, c + PRIOR
    return F.log(t0 / (all_t + 1 - t)) - F.log(c0 / (all_c + 1 - c)) - DEVIATIONS * F.sqrt(1 / t0 + 1 / c0)


def log_odds_of(t: int, c: int, all_t: int, all_c: int) -> float:
    t0, c0 = t + PRIOR, c + PRIOR
    return math.log(t0 / (all_t + 1 - t)) - math.log(c0 / (all_c + 1 - c)) - DEVIATIONS * math.sqrt(1 / t0 + 1 / c0)


def chance_rate(hits: list[tuple[float, int]], all_clean: int) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean tokens: chance segments thin out by exp(-rate * S)."""
    total = all_clean + 1.0
    share = [(w, (n + PRIOR / len(hits)) / total) for w, n in hits]
    rest = 1 - sum(p for _, p in share)
    low, high = 1e-3, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        over = sum(p * math.exp(min(700.0, mid * w)) for w, p in share) + rest * math.exp(mid * OTHER) > 1
        low, high = (low, mid) if over else (mid, high)
    return low


def segments(hits: list[tuple[int, float]], other: float = OTHER) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, end, score) in linear time.

    `hits` are the places and scores of positive tokens, every other token scores `other`. Each hit opens a
    candidate (left sum before, sum after); a candidate joins back to the last one that began lower and ended
    lower, as long as that one exists (the all-maximal-segments scan of Ruzzo and Tompa).
    """
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, last that began lower
    total, at = 0.0, 0
    for place, score in hits:
        total += other * (place - at)
        first, end, before, after = place, place + 1, total, total + score
        total, at = after, place + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= after:
                stack.append((first, end, before, after, j))
                break
            first, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, end, after - before) for first, end, before, after, _ in stack]


def passages(words: list[str], scores: TokenScores, rate: float) -> list[tuple[int, int, float, float]]:
    """(first token, end, score, expected number by chance) of each segment, the strongest first.

    Where positive tokens are rare, chance makes rate * |OTHER| * n * exp(-rate * S) segments of score S in n tokens.
    """
    hits = [(i, s) for i, s in enumerate(map(scores.__getitem__, words)) if s]
    found = sorted(segments(hits), key=lambda x: -x[2])
    return [(a, b, s, rate * -OTHER * len(words) * math.exp(-rate * s)) for a, b, s in found]


def below(r: int, expected: float) -> float:
    """The chance of fewer than r segments where `expected` are: a Poisson sum from its largest term down."""
    if r > expected:
        # The chance of r and more, whose terms fall from the first on.
        term = total = math.exp(r * math.log(expected) - expected - math.lgamma(r + 1)) if expected > 0 else 0.0
        i = r
        while term > 1e-17 * total:
            i += 1
            term *= expected / i
            total += term
        return 1 - total
    term = total = math.exp((r - 1) * math.log(expected) - expected - math.lgamma(r))
    for i in range(r - 1, 0, -1):
        term *= i / expected
        if term <= 1e-17 * total:
            break
        total += term
    return total


def toxicity(found: list[tuple[int, int, float, float]]) -> float:
    """One less the least chance of r segments as strong as the r-th, over all ranks; zero without a toxic token."""
    return max((min(1.0, max(0.0, below(r, expected))) for r, (_, _, _, expected) in enumerate(found, 1)), default=0.0)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, n_passages, passages) for each row, from the whole text.

    `passages` are the segments that chance hardly makes, as first:end:score in tokens. NULL and empty texts score
    zero. The model is bounded by MODEL_FEATURES and goes along with the function.
    """
    kept: dict[str, TokenScores] = {}

    def work(batch: pa.RecordBatch) -> dict:
        scores = kept.setdefault("scores", TokenScores(model["weights"]))
        found = [passages(tokens_of(t), scores, model["rate"]) for t in batch.column(1).to_pylist()]
        real = [[f for f in fs if f[3] <= 1 - TOXIC_FROM] for fs in found]
        return {"doc_id": batch.column(0), "score": [toxicity(fs) for fs in found],
                "n_passages": [len(fs) for fs in real],
                "passages": [",".join(f"{a}:{b}:{s:.3f}" for a, b, s, _ in fs) for fs in real]}

    return by_batch(docs.select(F.col("doc_id").cast("long"), "text"), work,
                    "doc_id long, score double, n_passages int, passages string")


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out third."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score",
                                     (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
                                     "n_passages", "passages")
