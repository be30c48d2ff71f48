"""Find personal data and secrets: rules, a gazetteer and context vote, and a span classifier learns from the votes.

One pass over the texts finds candidate spans. Base spans are certain. Each candidate, base or
not, gets three votes (for, against, none): of a strict pattern, of a gazetteer and of the words
before it. Expectation-maximisation over the counts of vote patterns, a table of bounded size, estimates
how reliable each labeler is and how likely each pattern is personal data. A logistic span classifier on the
span's own shape and context words learns those probabilities and decides about all candidates that are not base spans.
It is fitted on the distinct (kind, votes, features) with their counts over all spans; where a kind has more
of them than its share of the bound, on a priority sample, which keeps the frequent ones and weights the others so that counts stay right on average. Texts are read once and never shuffled.

Defined results: null text is empty; texts without spans have zero counts and empty lists; rows with the same id are
separate rows; an empty table gives no rows. Only the id and text columns are read. Secrets (keys in a provider's format, private keys,
values assigned to a word like password or token) may overlap base spans, as a key may hold digits that are a card number.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.text import saved

KINDS = ("email", "ip", "card", "phone", "name", "iban", "secret")
BASE_KINDS = KINDS[:4]
MAX_TRAINING_SPANS = 20_000
THRESHOLD = 0.5
EM_ROUNDS = 50

# Patterns of the base spans.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Further candidates.
_NATIONAL = re.compile(r"(?<![0-9+(])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}\x20?[\[(]dot[\])]\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra|Señor|Señora|Monsieur|Madame)\.?\x20([A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?)\b")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NEAR = re.compile(r"[^\W\d_]+")
_ASSIGNMENT = re.compile(r"[=:](?=[\x20\t]{0,3}[\"'`]?[^\s\"'`<>,;]{6})")
_VALUE = re.compile(r"[\x20\t]{0,3}[\"'`]?([^\s\"'`<>,;]+)")
_SECRET_NAME = re.compile(r"(?:passw(?:or)?d|passphrase|passwort|contraseña|mot de passe|pwd|secret|token|(?:api|access|private|auth)[_\x20-]?key|credential)s?"
                          r"[\"'`]?[\x20\t]{0,3}\Z", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"example|changeme|placeholder|required|redacted|your[_-]|\A(?:none|null|true|false)\Z|\A(.)\1*\Z", re.IGNORECASE)

# Formats of keys and tokens as their providers publish them.
_TOKEN_FORMATS = (
    "(?:AKIA|ASIA)[A-Z0-9]{16}", "gh[opsur]_[A-Za-z0-9]{36,255}", "github_pat_[A-Za-z0-9_]{22,255}", "glpat-[A-Za-z0-9_-]{20,255}",
    "xox[abprs]-[A-Za-z0-9-]{10,255}", "AIza[A-Za-z0-9_-]{35}", "[rs]k_live_[A-Za-z0-9]{16,255}",
    "eyJ[A-Za-z0-9_-]{10,4096}[.]eyJ[A-Za-z0-9_-]{10,4096}[.][A-Za-z0-9_-]{10,4096}",
)
_TOKEN = re.compile(f"(?:{'|'.join(_TOKEN_FORMATS)})(?![A-Za-z0-9_])")
_PRIVATE_KEY = re.compile("-----BEGIN [A-Z0-9\x20]{0,40}PRIVATE KEY-----")
_PRIVATE_KEY_END = re.compile("-----END [A-Z0-9\x20]{0,40}PRIVATE KEY-----")

# Gazetteers and words of context.
_TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io de fr es uk eu it nl ch at pl pt se no dk fi us ca au jp cn in br".split())
_GIVEN_NAMES = frozenset("anna maria john james robert michael david peter paul thomas hans karl pierre jean marie claire juan jose carlos luis carmen laura sarah emma".split())
_CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_CUES = {
    "email": frozenset("email mail contact write correo courriel adresse reply".split()),
    "ip": frozenset("ip address host server login adresse dirección".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta payment".split()),
    "phone": frozenset("phone tel call mobile fax telefon téléphone teléfono contact".split()),
    "name": frozenset("name dear signed by contact herr frau señor monsieur".split()),
    "iban": frozenset("iban account bank konto compte cuenta".split()),
    "secret": frozenset("password passwd pwd passphrase passwort passe contraseña secret token key credential credentials auth bearer login".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for match in _DOMAIN.finditer(text):
        start = match.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < match.start():
            done = match.end()
            yield start, done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans by kind, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", a, b) for a, b in _emails(text)]
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") for p in match.group().split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            found.append(("ip", match.start(), match.end()))
    for match in _CARD.finditer(text):
        digits = _digits(match.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= len(_digits(match.group())) <= 15:
                found.append(("phone", match.start(), match.end()))
    return found


def _iban_valid(span: str) -> bool:
    plain = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def secret_spans(text: str) -> list[tuple[int, int]]:
    """Keys and tokens of known formats, private keys, and values assigned to a telling name; the first of overlapping ones, then the longest."""
    found = [m.span() for m in _TOKEN.finditer(text) if m.start() == 0 or not (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")]
    end = None
    for match in _PRIVATE_KEY.finditer(text) if "PRIVATE KEY-----" in text else ():
        if end is None or end[0] < match.end():
            after = _PRIVATE_KEY_END.search(text, match.end())
            end = after.span() if after else (len(text) + 1, None)
        found.append((match.start(), end[1] or match.end()))
    done = 0
    for match in _ASSIGNMENT.finditer(text):
        at = match.start()
        if at >= done and _SECRET_NAME.search(text, max(0, at - 40), at):
            start, done = _VALUE.match(text, at + 1).span(1)
            stop = start + len(text[start:done].rstrip(".)]}"))
            if stop - start >= 6:
                found.append((start, stop))
    apart: list[tuple[int, int]] = []
    for start, stop in sorted(found, key=lambda f: (f[0], -f[1])):
        if not apart or start >= apart[-1][1]:
            apart.append((start, stop))
    return apart


def _further(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    found = [("phone", m.start(), m.end()) for m in _NATIONAL.finditer(text)]
    found += [("email", m.start(), m.end()) for m in _WRITTEN.finditer(text)] if "at" in text and "dot" in text else []
    found += [("name", m.start(1), m.end(1)) for m in _NAME.finditer(text)]
    found += [("iban", m.start(), m.end()) for m in _IBAN.finditer(text)]
    if not taken or not found:
        return found
    bounds = sorted((a, b) for _, a, b in taken)
    free, reach, at = [], 0, 0
    for kind, start, stop in sorted(found, key=lambda s: s[1]):
        while at < len(bounds) and bounds[at][0] < stop:
            reach = max(reach, bounds[at][1])
            at += 1
        if start >= reach:
            free.append((kind, start, stop))
    return free


def _votes(kind: str, span: str, before: list[str], base: bool) -> tuple[int, int, int]:
    """Strict pattern, gazetteer, context: 1 for, -1 against, 0 none."""
    if kind == "email":
        strict, listed = (1 if base else 0), (1 if re.split(r"[^a-z]+", span.lower())[-1] in _TOP_DOMAINS else -1)
    elif kind == "ip":
        strict, listed = (1 if base else -1), (-1 if span.split(".")[0] in ("0", "127") else 0)
    elif kind == "card":
        strict, listed = (1 if base else -1), (1 if _digits(span).startswith(_CARD_STARTS) else -1)
    elif kind == "phone":
        strict, listed = (1 if base else 0), (1 if re.search(r"\([0-9]{3}\)", span) else 0)
    elif kind == "iban":
        valid = _iban_valid(span)
        strict, listed = (1 if valid else -1), 0
    elif kind == "secret":
        known = _TOKEN.fullmatch(span) is not None or span.startswith("-----BEGIN ")
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        strict, listed = (1 if known or (mixed and len(span) >= 8) else -1 if span.isalpha() else 0), (
            1 if known else -1 if _PLACEHOLDER.search(span) else 0)
    else:
        strict, listed = 0, (1 if any(w in _GIVEN_NAMES for w in span.lower().split()) else 0)
    return strict, listed, (1 if _CUES[kind].intersection(before) else 0)


def _features(kind: str, span: str, before: list[str]) -> list[float]:
    n = len(span)
    shape = [n / 32, sum(c.isdigit() for c in span) / n, sum(c.isalpha() for c in span) / n, sum(c.isupper() for c in span) / n,
             sum(c in " -.()" for c in span) / n, float("@" in span), float(span.startswith("+"))]
    words = [0.0] * 8
    for word in before:
        words[int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=1).digest(), "big") % 8] += 0.2
    return [float(kind == k) for k in KINDS] + shape + words + [float(bool(_CUES[kind].intersection(before)))]


_SPANS = "array<struct<kind: string, start: int, stop: int, base: boolean, votes: array<int>, features: array<double>>>"


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for text in frame["text"]:
            text = text or ""
            base = base_spans(text)
            spans = []
            further = _further(text, base) + [("secret", a, b) for a, b in secret_spans(text)]
            for certain, found in ((True, base), (False, further)):
                for kind, start, stop in found:
                    before = [w.lower() for w in _NEAR.findall(text[max(0, start - 60): start])[-5:]]
                    span = text[start:stop]
                    spans.append({"kind": kind, "start": start, "stop": stop, "base": certain,
                                  "votes": list(_votes(kind, span, before, certain)),
                                  "features": _features(kind, span, before)})
            out.append(spans)
        yield pd.DataFrame({"doc_id": frame["doc_id"], "found": out})


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability of personal data for each (kind, votes), by expectation-maximisation over counted patterns.

    Every labeler has a distribution of its three votes for either truth; the share of true spans is per kind.
    """
    if not patterns:
        return {}
    kinds = sorted({kind for kind, _, _ in patterns})
    votes = np.array([v for _, v, _ in patterns]) + 1
    counts = np.array([n for _, _, n in patterns], dtype=float)
    of_kind = np.array([kinds.index(kind) for kind, _, _ in patterns])
    labelers = votes.shape[1]
    share = np.full(len(kinds), 0.5)
    # Labelers start out better than chance.
    table = np.tile(np.array([[0.5, 0.3, 0.2], [0.1, 0.4, 0.5]]), (labelers, 1, 1))
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        fit = np.log(np.stack([1 - share[of_kind], share[of_kind]], axis=1))
        for j in range(labelers):
            fit += np.log(table[j][:, votes[:, j]]).T
        posterior = 1 / (1 + np.exp(np.clip(fit[:, 0] - fit[:, 1], -50, 50)))
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        for j in range(labelers):
            for value in range(3):
                prior = (0.5, 0.3, 0.2)[value], (0.1, 0.4, 0.5)[value]
                table[j][:, value] = weight[:, votes[:, j] == value].sum(axis=1) + 10 * np.array(prior)
            table[j] /= table[j].sum(axis=1, keepdims=True)
        for k in range(len(kinds)):
            mine = of_kind == k
            share[k] = (weight[1, mine].sum() + 1) / (counts[mine].sum() + 2)
    return {(kind, v): float(p) for (kind, v, _), p in zip(patterns, posterior)}


def _fitted(features: np.ndarray, targets: np.ndarray, counts: np.ndarray | None = None, steps: int = 300, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression on probabilities, by Newton steps with a ridge; each row stands for ``counts`` equal ones."""
    x = np.hstack([features, np.ones((len(features), 1))])
    share = np.full(len(x), 1 / len(x)) if counts is None else counts / counts.sum()
    weights = np.zeros(x.shape[1])
    for _ in range(min(steps, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (share * (p - targets)) + penalty * weights
        curvature = (x * (share * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(curvature, gradient)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _training(spark: SparkSession, spans: DataFrame, kinds: list[str], most: int) -> list[tuple[Row, float]]:
    """Distinct (kind, votes, features) and the number of spans that each stands for.

    A kind with more than its share of ``most`` gives a priority sample: a vector of n spans has the priority n / u, with u
    from its hash; those of highest priority stay and stand for n spans, but at least for the first priority left out.
    """
    vectors = spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    u = (F.shiftrightunsigned(F.xxhash64("kind", "votes", "features"), 11) + 1) / F.lit(float(1 << 53))
    ranked = saved(vectors.withColumn("priority", F.col("n") / u), spark, "span-vectors")
    sizes = dict(ranked.groupBy("kind").count().collect())
    found, left = [], most
    # What a kind does not need of its share goes to the larger ones.
    for place, kind in enumerate(sorted(kinds, key=lambda k: (sizes[k], k))):
        each = min(sizes[kind], max(left // (len(kinds) - place), 1))
        left -= each
        rows = ranked.filter(F.col("kind") == kind).orderBy(F.desc("priority"), "votes", "features").limit(each + 1).collect()
        least = rows[each]["priority"] if len(rows) > each else 0.0
        found += [(r, max(float(r["n"]), least)) for r in rows[:each]]
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def _decide(frames: Iterator[pd.DataFrame], weights: np.ndarray | None, threshold: float) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, found in zip(frame["doc_id"], frame["found"]):
            base, everything = [], []
            for span in found:
                place = (span["kind"], span["start"], span["stop"])
                if span["base"]:
                    base.append(place)
                    everything.append(place)
                elif weights is not None and 1 / (1 + np.exp(-(np.append(span["features"], 1.0) @ weights))) >= threshold:
                    everything.append(place)
            counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
            rows.append((doc_id, *counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(everything),
                         sum(k == "secret" for k, _, _ in everything), len(everything)))
        yield pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret", "n_spans"]).astype({"doc_id": "Int64"})


def find_personal_data(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       max_training_spans: int = MAX_TRAINING_SPANS, threshold: float = THRESHOLD) -> DataFrame:
    """For each document: base counts, the digest of the base spans, all spans, and the numbers of secrets and of all spans."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = saved(texts.mapInPandas(_find, f"doc_id long, found {_SPANS}"), spark, "candidate-spans")
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    patterns = [(r["kind"], tuple(r["votes"]), r["n"]) for r in
                spans.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "votes").collect()]
    likely = reliabilities(patterns)
    sample = _training(spark, spans, sorted({kind for kind, _, _ in patterns}), max_training_spans)
    weights = None
    if sample:
        weights = _fitted(np.array([r["features"] for r, _ in sample]),
                          np.array([likely[r["kind"], tuple(r["votes"])] for r, _ in sample]), np.array([n for _, n in sample]))
    result = ", ".join(["doc_id long", *(f"n_{k} long" for k in BASE_KINDS), "base_sha256 string", "spans string", "n_secret long", "n_spans long"])
    return found.mapInPandas(lambda it: _decide(it, weights, threshold), result)
