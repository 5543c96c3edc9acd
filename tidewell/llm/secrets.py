"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are provider-shaped keys, key blocks, values that a name of a secret
is given to, and words of 20 and more key characters that stand alone with
letters and digits mixed. Each has features: length, shares of character kinds,
transitions between kinds, entropy and letter pairs, how much of it words of a
dictionary cover, what its path tells (tests, samples, lock files), and the
words around it. A random forest trained from labelled findings tells leaks from
look-alikes: digests in prose, identifiers, versions, placeholders, joined words.

The dictionary is the whole words of a public tokenizer's vocabulary, whose path
is a parameter. There is no table of labelled findings, so ``findings`` makes
them: labelled examples drawn from the public formats of keys and of what is
taken for them, with a fixed seed. ``fit`` takes any other labelled findings
alike; it runs once, and its trees go to the tasks.

Defined results: a null or empty text holds none; candidates are told from left
to right and don't overlap; where a candidate is no value (a name, a plain word
of prose), the search goes on within it; a secret that occurs twice is reported
twice, by place; rows that repeat are each scanned; without a column of paths
all paths are unknown; an empty table gives no rows. The time is linear in a
text's length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import operator
import random
import re
import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

# Public formats of keys.
PROVIDERS = {
    "aws_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\b(?:gh[pousr]_[0-9A-Za-z]{36}|github_pat_[0-9A-Za-z_]{22,82})\b",
    "slack": r"\bxox[abeprs]-[0-9A-Za-z-]{10,}+",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe": r"\b[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+",
    "openai": r"\bsk-[0-9A-Za-z_-]{20,}+",
    "gitlab": r"\bglpat-[0-9A-Za-z_-]{20,}+",
    "npm": r"\bnpm_[0-9A-Za-z]{36}\b",
    "jwt": r"\beyJ[0-9A-Za-z_-]{8,2000}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+",
    "private_key": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,40}PRIVATE KEY-----|\Z)",
}
#: Names that secrets are assigned to.
NAMES = r"(?:api|access|auth|secret|private|client)[_-]?(?:key|token|secret)|token|secret|passw(?:or)?d|pwd|passphrase|credentials?|bearer|authorization"
ASSIGNED = rf"""(?i:(?P<name>{NAMES})\w{{0,32}})["'\]]{{0,2}}\s{{0,8}}+(?P<sep>[:=]{{1,2}}>?|\bis\b|(?<=\s))\s{{0,8}}+(?P<quote>["'`]?)(?P<value>[A-Za-z0-9+/=_.\-!@#$%^&*]{{6,}}+)"""
#: A login in an address: what stands between its colon and its at sign.
LOGIN = r"""(?<=://)[^\s/:@"'<>]{0,64}+:(?P<login>[^\s/@"'<>]{3,128}+)@"""
#: Several words in quotes that a name of a pass phrase is given to.
PHRASE = r"""(?i:pass[_-]?(?:phrase|word))["'\]]{0,2}\s{0,8}+[:=]{1,2}\s{0,8}+(?P<mark>["'`])(?P<phrase>[A-Za-z0-9]{2,20}+(?: [A-Za-z0-9]{2,20}+){2,11}+)(?P=mark)"""
# Passwords that are plain words or runs of keys, as public lists of the most frequent have them.
FREQUENT = frozenset("abc123 admin admin123 baseball dragon football hunter2 iloveyou letmein login master monkey passw0rd password password1 princess qwerty qwerty123 qwertyuiop shadow solo starwars sunshine superman trustno1 welcome welcome1 1234567 12345678 123456789".split())
ALONE = r"(?<![A-Za-z0-9+/=_.\-@])(?=[A-Za-z+/=_\-]*+[0-9])(?=[0-9+/=_\-]*+[A-Za-z])[A-Za-z0-9+/=_\-]{20,}+(?![A-Za-z0-9+/=_.\-@])"
#: Parts of which every name, and every format that fits in less than 20 characters, has one.
HINTS = "key token secret passw pwd passphrase credential bearer authorization xox -----begin ://".split()
CANDIDATE = re.compile("|".join([*(f"(?P<{k}>{v})" for k, v in PROVIDERS.items()), f"(?P<url>{LOGIN})", f"(?P<words>{PHRASE})", f"(?P<assigned>{ASSIGNED})", f"(?P<alone>{ALONE})"]), re.S)
THRESHOLD = 0.5
AROUND = 40
_NAME = re.compile(NAMES, re.I)
_DENY = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|<|\$\{|test|fake|todo|redacted")
_HASHY = re.compile(r"(?i)\b(?:commit|sha\d*|md5|digest|checksum|hash|integrity|revision|etag|uuid|guid|version|build|id)\b")
_PATH = re.compile(r"(?i)test|spec|example|sample|fixture|mock|lock|doc|vendor|readme")
_LETTERS = re.compile(r"[a-z]{3,}")


@dataclass(frozen=True)
class Candidate:
    kind: str
    start: int
    end: int
    value: str
    name: str = ""
    given: bool = False  # by a colon or an equals sign
    quoted: bool = False


def hinted(text: str) -> bool:
    """Whether the text has what any candidate needs: a part of a name or format, or a piece of 20 characters."""
    low = text.casefold()
    return any(x in low for x in HINTS) or max(map(len, text.split()), default=0) >= 20


def candidates(text: str | None) -> list[Candidate]:
    if not text or not hinted(text):
        return []
    found, at = [], 0
    while m := CANDIDATE.search(text, at):
        at = m.end()
        if m["assigned"]:
            start, given = m.start("value"), bool(m["sep"]) and m["sep"].lower() != "is"
            value = m["value"].rstrip(".") if not m["quote"] else m["value"]
            word = value.isalpha() and (value.islower() or value.istitle() or value.isupper())
            if len(set(value)) < 4 or _NAME.fullmatch(value) or not given and (word or len(value) < 8):
                at = start  # what stands there may itself be a name, or a key
                continue
            found.append(Candidate("assigned", start, start + len(value), value, m["name"].lower(), given, bool(m["quote"])))
        elif m["url"]:
            found.append(Candidate("url", m.start("login"), m.end("login"), m["login"], "password", True))
        elif m["words"]:
            if 2 * len(_PROSE.findall(m["phrase"])) > m["phrase"].count(" ") + 1:
                at = m.start("phrase")  # a sentence
                continue
            found.append(Candidate("phrase", m.start("phrase"), m.end("phrase"), m["phrase"], "passphrase", True, True))
        else:
            kind = next(k for k in (*PROVIDERS, "alone") if m[k])
            found.append(Candidate(kind, m.start(), m.end(), m[0]))
    return found


# --------------------------------------------------------------- dictionary
@functools.lru_cache(2)
def dictionary(path: str | None = None) -> frozenset[str]:
    """The whole words of four letters and more in the vocabulary of a ``tokenizers`` file with word ends."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    end = model["end_of_word_suffix"]
    return frozenset(w for t in model["vocab"] if t.endswith(end) and len(w := t[: -len(end)]) >= 4 and w.isascii() and w.isalpha())


LONGEST = 14


def coverage(value: str, words: frozenset[str]) -> float:
    """The share of a value's characters that words of the dictionary cover, the longest first from left to right."""
    covered = 0
    for m in _LETTERS.finditer(value.lower()):
        run, at = m[0], 0
        while at <= len(run) - 4:
            n = next((n for n in range(min(LONGEST, len(run) - at), 3, -1) if run[at : at + n] in words), 0)
            covered += n
            at += n or 1
    return covered / len(value)


# ----------------------------------------------------------------- features
#: Words of prose, as opposed to random words of a pass phrase.
_PROSE = re.compile(r"(?i)\b(?:a|an|the|your|is|are|to|of|for|in|please|enter|must|be|and|or|not|invalid|here|this|password|passphrase)\b")
_WORDS = re.compile(r"[a-z]+")


@functools.lru_cache(2)
def transitions(words: frozenset[str]) -> dict[str, float]:
    """Log probabilities of a letter after a letter in the dictionary's words; a pair that none has is as rare as one can be."""
    pairs, first = Counter(), Counter()
    for w in words:
        pairs.update(map(operator.add, w, w[1:]))
        first.update(w[:-1])
    return {x + y: math.log((pairs[x + y] + 0.5) / (first[x] + 13)) for x in string.ascii_lowercase for y in string.ascii_lowercase}


def surprise(value: str, words: frozenset[str]) -> float:
    """How unlikely a value's letters follow each other in a word, on average; 0 without two letters in a row."""
    known = transitions(words)
    found = [known[x + y] for run in _WORDS.findall(value.lower()) for x, y in zip(run, run[1:], strict=False)]
    return -sum(found) / len(found) if found else 0.0


FEATURES = 22


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def features(c: Candidate, text: str, path: str | None, words: frozenset[str]) -> tuple[float, ...]:
    v = c.value
    n = len(v)
    kinds = list(map(_kind, v))
    moves = sum(map(operator.ne, kinds, kinds[1:])) / max(1, n - 1)
    counts = Counter(v)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = v.lower()
    near = text[max(0, c.start - AROUND) : c.start]
    around = near + " " + text[c.end : c.end + AROUND]
    return (
        float(min(n, 200)),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        moves,
        entropy,
        surprise(v, words),
        coverage(v, words),
        float(all(x in string.hexdigits for x in v)),
        float(c.kind not in ("assigned", "alone", "url", "phrase")),
        float(c.kind == "assigned" or bool(_NAME.search(near))),
        float(bool(_DENY.search(around) or _DENY.search(v))),
        float(bool(_HASHY.search(near))),
        float(bool(path and _PATH.search(path))),
        float(max(counts.values()) / n),
        float(c.given),
        float(c.quoted),
        float(c.name.startswith("pass") or c.name == "pwd"),
        float(low in FREQUENT),
        float(c.kind == "url"),
        len(_PROSE.findall(v)) / (1 + v.count(" ")) if c.kind == "phrase" else -1.0,
    )


# ------------------------------------------------------------------- forest
class Forest:
    """Bagged trees on random features; trees are arrays of nodes."""

    def __init__(self, trees: list[np.ndarray]):
        self.trees = trees  # rows (feature, threshold, low, high, value); feature -1 is a leaf

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least: int = 3, seed: int = 11) -> Forest:
        rng, out = np.random.default_rng(seed), []
        for _ in range(trees):
            own = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            cls._grow(x[own], y[own], depth, least, rng, nodes)
            out.append(np.array(nodes))
        return cls(out)

    @classmethod
    def _grow(cls, x, y, depth, least, rng, nodes) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth and len(y) >= 2 * least and 0 < y.mean() < 1:
            best = (1e-9, -1, 0.0)
            p = y.mean()
            for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False).tolist():
                order = np.argsort(x[:, f], kind="stable")
                xs, ys = x[order, f], y[order].cumsum()
                k = np.arange(1, len(y))
                ok = (xs[1:] > xs[:-1]) & (k >= least) & (len(y) - k >= least)
                if ok.any():
                    a, b = ys[:-1] / k, (ys[-1] - ys[:-1]) / (len(y) - k)
                    gain = np.where(ok, p * (1 - p) - k / len(y) * a * (1 - a) - (1 - k / len(y)) * b * (1 - b), 0)
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], f, float((xs[i] + xs[i + 1]) / 2))
            if best[1] >= 0:
                low = x[:, best[1]] <= best[2]
                nodes[me][:2] = [best[1], best[2]]
                nodes[me][2] = cls._grow(x[low], y[low], depth - 1, least, rng, nodes)
                nodes[me][3] = cls._grow(x[~low], y[~low], depth - 1, least, rng, nodes)
        return me

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := t[at, 0] >= 0).any():
                node = t[at]
                go = np.where(x[np.arange(len(x)), np.maximum(node[:, 0], 0).astype(int)] <= node[:, 1], node[:, 2], node[:, 3]).astype(np.int64)
                at = np.where(inner, go, at)
            total += t[at, 4]
        return total / len(self.trees)


def findings(n: int = 4000, seed: int = 5, words: frozenset[str] | None = None) -> list[tuple[str, str, bool]]:
    """Labelled findings (text, path, leak) of public formats."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"
    sylls = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ción que mente para eau tre ung keit sch".split()
    real = sorted(dictionary() if words is None else words)
    made = lambda: "".join(r.choice(sylls) for _ in range(r.randint(1, 4)))
    word = lambda: r.choice(real) if real and r.random() < 0.5 else made()
    prose = lambda: " ".join(word() for _ in range(r.randint(2, 9)))
    loud = lambda s: s.upper() if r.random() < 0.15 else s
    name = lambda: r.choice(["token", "api_key", "apikey", "secret", "password", "access_token", "client_secret", "auth_token", "private_key", "passwd"])
    login = lambda: r.choice(["password", "passwd", "pwd", "passphrase", "db_password", "PASSWORD"])
    eq = lambda: r.choice([" = ", "=", ": ", '": ', " : "])
    key = lambda: r.choice([lambda: pick(hexa, r.choice([32, 40, 48, 64])), lambda: pick(alnum, r.randint(12, 48)), lambda: pick(alnum + "+/", r.choice([40, 44, 64])), lambda: pick(alnum + "-_", r.randint(24, 60)), lambda: pick(alnum + "!@#$%", r.randint(10, 18))])()
    leet = lambda w: "".join({"o": "0", "a": "4", "e": "3", "i": "1"}.get(x, x) if r.random() < 0.5 else x for x in w)
    phrase = lambda: r.choice([lambda: f"{word()}{r.randint(0, 9999)}", lambda: f"{leet(word()).capitalize()}{r.choice('!@#$%&*-_')}{r.randint(0, 99)}{pick(string.ascii_lowercase, 1)}", lambda: f"{word()}{word()}{r.randint(1, 99)}{r.choice('!@#$%')}", lambda: leet(word() + word())])()
    quotes, frequent = ["\"", "'"], sorted(FREQUENT)
    close = lambda s: s + next((x for x in s if x in quotes), "")
    out = []
    for k in range(n):
        q = r.choice(['"', "'", ""])
        path = r.choice(["src/app.py", "config/prod.yml", f"{made()}{r.randint(0, 99)}", f"{made()}.md", "deploy/env.sh", "notes.txt", ""])
        if k % 2:
            body = r.choice([lambda: f"{name()}{eq()}{q}{key()}{q}", lambda: f"{name()}{eq()}{q}{key()}{q}", lambda: f"{login()}{eq()}{q}{phrase()}{q}", lambda: f"{name()} {login()}: {q}{phrase()}{q}", lambda: f"{r.choice(['the', 'my', 'root'])} {login()} is {q}{pick(alnum, 3)}{r.randint(10, 99)}{pick(alnum + '!@#$%', r.randint(5, 9))}{q}", lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk-" + pick(alnum, 40), lambda: "glpat-" + pick(alnum + "_-", 20), lambda: "npm_" + pick(alnum, 36), lambda: f"{r.choice(['mysql', 'postgres', 'https', 'amqp', 'redis'])}://{made()}:{r.choice([phrase, key, lambda: word() + word()])().replace('/', '').replace('@', '')}@{word()}.{made()}:{r.randint(80, 9999)}/{made()}", lambda: close(f"passphrase{r.choice([' = ', ': ', '='])}{r.choice(quotes)}{' '.join(r.choice(real) if real else made() for _ in range(r.randint(3, 7)))}"), lambda: f"{login()}{eq()}{q}{r.choice(frequent)}{q}", lambda: f"xoxb-{pick(string.digits, 11)}-{pick(alnum, 24)}", lambda: "AIza" + pick(alnum, 35), lambda: f"sk_live_{pick(alnum, 24)}", lambda: f"eyJ{pick(alnum, 20)}.{pick(alnum, 40)}.{pick(alnum, 43)}", lambda: f"Authorization: Bearer {pick(alnum, 40)}"])()
            out.append((loud(f"{prose()} {body} {prose()}") if "=" in body else f"{prose()} {body} {prose()}", path, True))
        else:
            body = r.choice(
                [
                    lambda: f"{r.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'digest', 'revision', 'etag'])} {pick(hexa, r.choice([32, 40, 64]))}",
                    lambda: f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
                    lambda: f"{name()}{eq()}{q}{r.choice(['YOUR_API_KEY_HERE1', 'xxxxxxxxxxxxxxxx', 'changeme123', 'example-token-123', '${API_KEY}1', 'placeholder_value', 'test_password_1'])}{q}",
                    lambda: f"{name()} {r.choice(['is', ''])} {word()}{word()}{word()}",
                    lambda: f"{login()}{r.choice([': ', ' = ', '='])}{r.choice(['required', 'optional', 'hidden', 'string', 'invalid', 'expired', 'missing', word(), word()])}",
                    lambda: f"{name()}{r.choice([': ', ' = ', '='])}{r.choice(['string', 'required', 'optional', 'undefined', 'getenv', 'String', 'function', 'expired', word(), word()])}",
                    lambda: f"{word()}_{word()}_{word()}{r.randint(1, 99)}_{word()}",
                    lambda: f"{word()}://{made()}:{r.choice(['password', 'PASSWORD', 'pass', 'changeme', '${DB_PASSWORD}', '<password>', 'xxxx', 'your_password'])}@{word()}.example/{made()}",
                    lambda: close(f"{login()}{r.choice([' = ', ': ', '='])}{r.choice(quotes)}{r.choice(['please enter your', 'this must be a', 'invalid or', 'the', 'enter the'])} {word()} {word()} {r.choice(['here', 'for this', 'in the', 'of your', 'to be'])} {word()}"),
                    lambda: close(f"{r.choice(['password', 'passphrase'])}{r.choice([' = ', ': ', '='])}{r.choice(quotes)}{r.choice(['please enter your', 'this must be a', 'invalid or', 'the', 'enter the'])} {word()} {word()} {r.choice(['here', 'for this', 'in the', 'of your', 'to be'])} {word()}"),
                    lambda: f"{word()}-{word()}-{word()}-{r.randint(2000, 2030)}-{word()}",
                    lambda: f"https://www.{word()}.example.com/{word()}/{word()}{r.randint(1, 99)}/{word()}",
                    lambda: f"{name()}{eq()}{q}{word()}{word()}{word()}{word()}{q}",
                    lambda: f"{name()}{eq()}{q}{word()}_{word()}.{word()}{r.randint(1, 9)}{q}",
                    lambda: f"version {r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 99)}+build{pick(string.digits, 14)}",
                    lambda: f"/usr/lib/{word()}/{word()}{r.randint(1, 9)}/{word()}_{word()}",
                ]
            )()
            out.append((f"{prose()} {body} {prose()}", r.choice([path, "tests/fixture.json", "package-lock.json", "docs/readme.md"]), False))
    return out


@dataclass(frozen=True)
class Model:
    forest: Forest
    words: frozenset[str]


def fit(labelled: list[tuple[str, str, bool]], words: frozenset[str]) -> Model:
    x, y = [], []
    for text, path, leak in labelled:
        for c in candidates(text):
            x.append(features(c, text, path, words))
            y.append(float(leak))
    return Model(Forest.fit(np.array(x).reshape(-1, FEATURES), np.array(y)), words)


@functools.lru_cache(1)
def forest() -> Model:
    """The model of the made findings and the default dictionary."""
    words = dictionary()
    return fit(findings(words=words), words)


def secrets(text: str | None, path: str | None, model: Model, threshold: float = THRESHOLD) -> list[tuple[Candidate, float]]:
    found = candidates(text)
    if not found:
        return []
    score = model.forest.score(np.array([features(c, text, path, model.words) for c in found]))
    return [(c, float(s)) for c, s in zip(found, score, strict=True) if s >= threshold]


# --------------------------------------------------------------- operators
def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", model: Model | None = None) -> DataFrame:
    """Rows (doc_id, kind, start_at, length, score, sha256) of each secret; the secrets themselves are not repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(model or forest())
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")

    def run(batches):
        own = shared.value
        for part in common.slices(batches):
            rows = [(i, c.kind, c.start, c.end - c.start, s, hashlib.sha256(c.value.encode()).hexdigest()) for i, t, p in zip(*(c.to_pylist() for c in part.columns), strict=True) for c, s in secrets(t, p, own)]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["doc_id", "kind", "start_at", "length", "score", "sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), path.alias("path")).mapInArrow(run, "doc_id long, kind string, start_at long, length long, score double, sha256 string")


def redacted(docs: DataFrame, *, text_col: str = "text", path_col: str | None = "source", size_col: str | None = "n_chars", mark: str = "[SECRET]", model: Model | None = None) -> DataFrame:
    """The documents with ``mark`` for each secret, and their length where ``size_col`` has it."""
    shared, schema = docs.sparkSession.sparkContext.broadcast(model or forest()), docs.schema
    at = docs.columns.index(text_col)
    path_at = docs.columns.index(path_col) if path_col in docs.columns else None
    size_at = docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches):
        own = shared.value
        for part in common.slices(batches):
            texts = part.column(at).to_pylist()
            paths = part.column(path_at).to_pylist() if path_at is not None else [None] * len(texts)
            changed = {}
            for k, (t, p) in enumerate(zip(texts, paths, strict=True)):
                if found := secrets(t, p, own):
                    pieces, end = [], 0
                    for c, _ in found:
                        pieces += [t[end : c.start], mark]
                        end = c.end
                    changed[k] = "".join([*pieces, t[end:]])
            if changed:
                columns = list(part.columns)
                columns[at] = pa.array([changed.get(k, t) for k, t in enumerate(texts)], part.schema.field(at).type)
                if size_at is not None:
                    columns[size_at] = pa.array([len(changed[k]) if k in changed else n for k, n in enumerate(part.column(size_at).to_pylist())], part.schema.field(size_at).type)
                part = pa.RecordBatch.from_arrays(columns, names=part.schema.names)
            yield part

    return docs.mapInArrow(run, schema)


# ------------------------------------------------------------------- query
def op10_secret_forest(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
