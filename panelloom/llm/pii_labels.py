"""Personal data by weak supervision.

Base spans follow fixed patterns; they are certain and always stay. Beyond them, candidates (long mixed tokens,
numbers of the social-security form, other long digit groups) get votes from labelers of five sorts: strict
patterns; gazetteers of key prefixes and of number ranges that are or aren't given out; cue words in the CONTEXT
characters before; shape; and forms of things that are no personal data (UUIDs, slugs, names with a number, dates,
book numbers). One pass over the corpus counts how often each pattern of votes and discrete features occurs; the number of
patterns is bounded by the labelers, not by the data. Expectation-maximisation over those counts estimates, kind by
kind, each labeler's reliability and the probability that a pattern is personal data; a labeler's reliability starts
from a prior that is better than chance (PRIORS), which weighs STRENGTH votes and HOLD times those seen. So few
candidates can't turn the classes round, and a corpus in which all candidates are personal can't make labelers
worthless that never had to vote against one. Each kind has its logistic span classifier, trained on the features against
these probabilities, and on every pattern of votes once, so that patterns that the corpus lacks, and kinds
without candidates, are decided by the labelers' reliabilities. A second pass adds the candidates that are accepted
and that touch no base span.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; a candidate or a
text may have any length, and time is linear in it; repeated rows each get their row; of candidates that overlap
the one that starts first counts, at a tie the one first in KINDS; a probability of exactly one half is accepted; a
corpus without candidates adds nothing; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts

# Kinds in their order; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "ssn", "number")
BASE = KINDS[:4]
#: Characters before a candidate in which cue words and quotes are looked for.
CONTEXT = 24
_RANK = {k: i for i, k in enumerate(KINDS)}

# Gazetteers and cue words.
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "pk-", "xoxb-", "xoxp-", "AIza", "eyJ")
CUES = re.compile(r"(?i)\b(?:pass(?:word|wd|code)?|pwd|token|secret|api[_ -]?key|key|auth|credential|card|visa|iban|account|tel|phone|call|mobile|fax|mail|contact|ssn|ip|host|login)\b\W*\Z")
ANTI_CUES = re.compile(
    r"(?i)\b(?:version|v|isbn|issn|doi|page|pages|section|chapter|fig|figure|table|no|rfc|commit|revision|rev|license|copyright|sha1|sha-1|sha256|sha-256|sha512|md5"
    r"|checksum|digest|hash|etag|blob|tree|build|release|branch|tag|uuid|guid|slug|url|sku|order|invoice|ticket|issue)\b\W*\Z"
)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512); keys have these lengths too.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
#: Between dashes or underscores: a word, a word with a number, or a short number; of one piece only, a word with a short number.
_SLUG_PART = re.compile(r"[A-Za-z]{2,}[0-9]{0,4}|[0-9]{1,4}|[A-Za-z]")
_NAMED = re.compile(r"(?=[^0-9]*[aeiouyAEIOUY])[A-Za-z]{6,}[0-9]{1,4}")
#: North American telephone numbers: area and exchange start with 2 to 9, and don't end in 11.
_NANP = re.compile(r"(?:1[ .-])?([2-9][0-9]{2})[ .-]([2-9][0-9]{2})[ .-][0-9]{4}")
_DATE = re.compile(r"(?:1[89]|20)[0-9]{2}([-. ]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?:[ -]?[0-2][0-9][0-5][0-9](?:[0-5][0-9])?)?")

_ANY = re.compile(r"[0-9@]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match starts where a run of digits starts, so that these take time linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+(?![A-Za-z0-9_-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9.-])[0-9](?:[ .-]?[0-9]){6,18}(?![0-9.-])")
_STRICT_SECRET = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{16,}|(?:ghp_|gho_|sk-|pk-|xox[bp]-)[A-Za-z0-9_-]{12,}")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of the base spans, in order."""
    if not _ANY.search(text):
        return []
    out, free = [], 0
    if "@" in text:
        for m in _AT.finditer(text):
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group()) if m.end() - m.start() <= 37 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGITS.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Further candidates, none of which touches a base span or an earlier candidate."""
    if not _ANY.search(text):
        return []
    found = [(m.start(), _RANK["ssn"], m.end()) for m in _SSN.finditer(text)]
    for m in _TOKEN.finditer(text):
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            found.append((m.start(), _RANK["secret"], m.end()))
    found += [(m.start(), _RANK["number"], m.end()) for m in _NUMBER.finditer(text)]
    found.sort(key=lambda x: (x[0], x[1]))
    starts, ends = [], []  # of the base spans, joined where they touch
    for a, _, b in base:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out, free = [], 0
    for start, kind, end in found:
        k = bisect_left(starts, end) - 1
        if start >= free and (k < 0 or ends[k] <= start):
            out.append((start, kind, end))
            free = end
    return out


def _given_out(ssn: str) -> bool:
    return not (ssn[:3] in ("000", "666") or ssn[0] == "9" or ssn[4:6] == "00" or ssn[7:] == "0000")


def _strict(name: str, v: str) -> str:
    if name == "secret":
        found = _STRICT_SECRET.fullmatch(v)
        return "0" if found and len(v) in DIGESTS and v[0] in "0123456789abcdef" else "+" if found else "-"
    if name == "ssn":
        return "+" if _given_out(v) else "0"
    digits = _DIGITS.sub("", v)
    return "+" if _NANP.fullmatch(v) or len(digits) == 13 and digits[0] == "4" and luhn(digits) else "-"


def _gazette(name: str, v: str) -> str:
    """Prefixes of keys; areas and groups of social-security numbers that are never given out; area codes and exchanges."""
    if name == "secret":
        return "+" if v.startswith(SECRET_PREFIXES) else "0"
    if name == "ssn":
        return "+" if _given_out(v) else "-"
    if found := _NANP.fullmatch(v):
        return "-" if "11" in (found[1][1:], found[2][1:]) or found[2] == "555" and v[-4:-2] == "01" else "+"
    return "0"


def _form(name: str, v: str) -> str:
    """Forms that are no personal data; for tokens, many changes between letters and digits speak for a key."""
    if name == "ssn":
        return "0"
    if name == "number":
        digits = _DIGITS.sub("", v)
        book = len(digits) == 13 and digits[:3] in ("978", "979") and sum(int(c) * (1 + i % 2 * 2) for i, c in enumerate(digits)) % 10 == 0
        return "-" if book or _DATE.fullmatch(v) else "0"
    parts = re.split("[-_]", v) if len(v) <= 128 else [v]
    slug = len(parts) > 1 and all(_SLUG_PART.fullmatch(p) for p in parts if p) and any(p.isalpha() and len(p) > 2 for p in parts)
    if _UUID.fullmatch(v) or slug or _NAMED.fullmatch(v):
        return "-"
    if _STRICT_SECRET.fullmatch(v):
        return "0"
    return "+" if sum(x.isdigit() != y.isdigit() for x, y in zip(v, v[1:])) * 5 >= len(v) else "0"


def votes(text: str, span: tuple[int, int, int]) -> str:
    """A letter of + (personal), - (not) or 0 (no opinion) from each labeler, for a candidate."""
    start, kind, end = span
    name, v, before = KINDS[kind], text[start:end], text[max(0, start - CONTEXT) : start]
    context = "+" if CUES.search(before) else "-" if ANTI_CUES.search(before) else "0"
    kinds = len({*v.lower()} - {" ", "-", "."})
    shape = "-" if kinds <= 3 else "+" if kinds >= 7 else "0"
    return _strict(name, v) + _gazette(name, v) + context + shape + _form(name, v)


def features(text: str, span: tuple[int, int, int]) -> str:
    """Discrete features of a candidate, as a short code: one digit for each."""
    start, kind, end = span
    v, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = sum(c.isdigit() for c in v) / len(v)
    case = 0 if not any(c.isalpha() for c in v) else 1 if v.upper() == v else 2 if v.lower() == v else 3
    joined = 1 if before[-1:] in ("=", '"', "'", ":") else 0
    vote = ["0-+".index(c) for c in votes(text, span)]
    return f"{kind - len(BASE)}{min(3, (end - start) // 8)}{int(digits * 2.99)}{case}{joined}{''.join(map(str, vote))}"


#: Values of each feature after the kind; the last ones are the votes.
_WIDTHS = (4, 3, 4, 2, 3, 3, 3, 3, 3)
#: What is held of a labeler before any vote is seen: chances of +, - and 0 for personal data, and for other spans.
PRIORS = (
    ((0.55, 0.15, 0.3), (0.1, 0.5, 0.4)),  # strict patterns
    ((0.4, 0.1, 0.5), (0.1, 0.4, 0.5)),  # gazetteers
    ((0.6, 0.03, 0.37), (0.05, 0.5, 0.45)),  # context
    ((0.6, 0.1, 0.3), (0.45, 0.25, 0.3)),  # shape
    ((0.5, 0.05, 0.45), (0.2, 0.4, 0.4)),  # form
)
LABELERS = len(PRIORS)
#: The prior of a labeler weighs STRENGTH votes and HOLD times those seen, that of the share of personal data STRENGTH candidates and those seen.
STRENGTH = 20.0
HOLD = 3.0
SHARE = 0.3


def _one_hot(codes: list[str]) -> np.ndarray:
    """Features of codes without their kind; a dot is a feature that is not known."""
    out = np.zeros((len(codes), 1 + sum(_WIDTHS)))
    out[:, 0] = 1
    for r, code in enumerate(codes):
        at = 1
        for w, c in zip(_WIDTHS, code, strict=True):
            if c != ".":
                out[r, at + int(c)] = 1
            at += w
    return out


@dataclass
class SpanModel:
    """Weights of each kind's span classifier, and what expectation-maximisation found of it."""

    weights: dict[str, np.ndarray]
    share: dict[str, float]  # of personal data among the kind's candidates
    reliability: dict[str, np.ndarray]  # labelers x class (other, personal) x vote (+, -, 0)

    def accepts(self, code: str) -> bool:
        return bool(_one_hot([code[1:]])[0] @ self.weights[KINDS[len(BASE) + int(code[0])]] >= 0)


def vote_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(pattern, n): how often each pattern of votes and features of a candidate occurs; summed up within tasks first."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                t = (t or b"").decode("utf-8", "replace")
                for span in candidates(t, base_spans(t)):
                    seen[f"{votes(t, span)}{features(t, span)}"] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    each = docs.select(F.col(f"`{text}`").cast("binary").alias("utf8")).mapInArrow(run, "pattern string, n long")
    return each.groupBy("pattern").agg(F.sum("n").alias("n"))


def _odds(which: np.ndarray, share: float, rel: np.ndarray) -> np.ndarray:
    """Logarithmic odds of personal data for rows of votes."""
    return np.log(share) - np.log(1 - share) + sum(np.log(rel[k, 1][which[:, k]]) - np.log(rel[k, 0][which[:, k]]) for k in range(LABELERS))


def _posterior(which: np.ndarray, share: float, rel: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_odds(which, share, rel), -35, 35)))


def _which(patterns: list[str]) -> np.ndarray:
    return np.array([["+-0".index(c) for c in p[:LABELERS]] for p in patterns], int).reshape(-1, LABELERS)


def estimate(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float, np.ndarray]:
    """For one kind: the posterior of each pattern of votes, the share of personal data, and labeler reliabilities.

    Expectation-maximisation with Dirichlet priors: each reliability is PRIORS with the weight of STRENGTH votes and
    HOLD times those seen, and the votes seen; the share's prior has the weight of STRENGTH candidates and those seen.
    """
    which = _which(patterns)
    held = np.array(PRIORS)[:, ::-1]  # other, personal
    share, rel = SHARE, held
    for _ in range(rounds):
        post = _posterior(which, share, rel)
        both = np.stack([(1 - post) * counts, post * counts])
        share = float((both[1].sum() + SHARE * (STRENGTH + counts.sum())) / (2 * counts.sum() + STRENGTH))
        seen = np.array([[np.bincount(which[:, k], weights=both[y], minlength=3) for y in range(2)] for k in range(LABELERS)])
        n = seen.sum(axis=2, keepdims=True)
        rel = (seen + (STRENGTH + HOLD * n) * held) / (n + STRENGTH + HOLD * n)
    return post, share, rel


def train(patterns: list[str], counts: np.ndarray, l2: float = 0.1) -> SpanModel:
    """Expectation-maximisation for each kind, then its classifier against the posteriors, by Newton steps."""
    every = ["".join(p) for p in product("+-0", repeat=LABELERS)]
    codes = ["." * (len(_WIDTHS) - LABELERS) + "".join(str("0-+".index(c)) for c in p) for p in every]
    weights, share, rel = {}, {}, {}
    for k, name in enumerate(KINDS[len(BASE) :]):
        own = [i for i, p in enumerate(patterns) if p[LABELERS] == str(k)]
        post, share[name], rel[name] = estimate([patterns[i] for i in own], counts[own])
        x = _one_hot([*(patterns[i][LABELERS + 1 :] for i in own), *codes])
        n = np.concatenate([counts[own], np.ones(len(every))])
        post = np.concatenate([post, _posterior(_which(every), share[name], rel[name])])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            gradient = x.T @ (n * (p - post)) + l2 * w
            hessian = (x * (n * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        weights[name] = w
    return SpanModel(weights, share, rel)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", l2: float = 0.1) -> SpanModel | None:
    """The span classifier, from vote patterns of all documents; None if there are no candidates."""
    # The votes are among the features, so there are at most 3 x 4 x 3 x 4 x 2 x 3^5 = 69,984 patterns, whatever the corpus.
    rows = sorted(vote_counts(docs, id_col, text).collect(), key=lambda r: r["pattern"])
    if not rows:
        return None
    return train([r["pattern"] for r in rows], np.array([r["n"] for r in rows], float), l2)


def all_spans(text: str, model: SpanModel | None, known: dict[str, bool]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans."""
    base = base_spans(text)
    added = []
    for span in candidates(text, base) if model is not None else ():
        code = features(text, span)
        if code not in known:
            known[code] = model.accepts(code)
        if known[code]:
            added.append(span)
    return base, sorted([*base, *added])


def join(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_pii(docs: DataFrame, model: SpanModel | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own, known = sent.value, {}

        def run(_, texts):
            out = [[] for _ in range(7)]
            for t in texts:
                base, every = all_spans(t.decode("utf-8", "replace"), own, known)
                for k in range(4):
                    out[k].append(sum(s[1] == k for s in base))
                out[4].append(hashlib.sha256(join(base).encode()).hexdigest())
                out[5].append(join(every))
                out[6].append(len(every) - len(base))
            return out

        return run

    return map_texts(docs, make, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", id_col, text)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its kind in angle brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: SpanModel | None, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with personal data replaced; n_chars follows, if there; a null text stays null. All other columns pass through."""
    sent, names, schema = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.schema

    def run(batches):
        import pyarrow as pa

        own, known = sent.value, {}
        at, n_at = names.index(text), names.index(n_chars) if n_chars in names else -1
        for b in batches:
            cols = list(b.columns)
            old = cols[at].to_pylist()
            new = [t if t is None else redact(t, all_spans(t, own, known)[1]) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if n_at >= 0:
                was = cols[n_at].to_pylist()
                cols[n_at] = pa.array([w if t is None or s == t else len(s) for w, t, s in zip(was, old, new, strict=True)], cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, schema)  # plain names, as mapInArrow resolves dots


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find_pii(docs, fit(docs))


QUERIES = {"op3_pii": op3_pii}
