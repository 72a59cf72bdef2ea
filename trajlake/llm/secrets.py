"""Secret scans: candidates from whole texts, false positives removed by a random forest in native expressions."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"
BLANKS = r"[\x20\x09-\x0D]+"
#: Names whose assigned values are candidates from 8 characters on, whatever they consist of.
NAMES = r"(?:token|secret|passw|pwd|credential|bearer|auth|api.?key|access.?key|private)"
ASSIGNED = rf"(?i){NAMES}[A-Za-z0-9_]*[\"']?[=:]+[\"']?([^\"',;=:]{{8,}})"
FOLLOWING = r"^[\"']?([^\"',;]{8,})"
#: Common words of English, German, French and Spanish and frequent letter groups of theirs: what secrets do not consist of.
DICTIONARY = (
    "the", "and", "that", "have", "for", "not", "with", "you", "this", "but", "his", "from", "they", "her", "she", "will", "one", "all", "would", "there", "their", "what", "about", "which", "when",
    "make", "like", "time", "just", "know", "take", "people", "into", "year", "good", "some", "could", "them", "see", "other", "than", "then", "now", "look", "only", "come", "over", "think", "also",
    "back", "after", "use", "two", "how", "our", "work", "first", "well", "way", "even", "new", "want", "because", "any", "these", "give", "day", "most", "number", "name", "file", "path", "data",
    "http", "www", "html", "com", "org", "net", "index", "page", "key", "value", "test", "example", "sample", "user", "your", "password", "token", "secret", "here", "place", "holder", "config", "class",
    "der", "die", "und", "den", "von", "das", "mit", "sich", "des", "auf", "ist", "dem", "nicht", "ein", "eine", "als", "auch", "nach", "wie", "les", "une", "est", "que", "pour", "qui", "dans", "par",
    "sur", "plus", "avec", "los", "del", "las", "por", "con", "para", "como", "pero", "sus",
    "ing", "ion", "tio", "ent", "ati", "ter", "ate", "ver", "ere", "res", "men", "ted", "ers", "pro", "ess", "ive", "ect", "int", "sta", "ist", "sch", "ung", "che", "gen", "ait", "eur", "ado", "nte",
)
TELLING = rf"(?i){NAMES}"
HARMLESS = r"(?i)(sha\d*|md5|digest|checksum|hash|commit|revision|uuid|guid|etag|http|integrity|example|placeholder)"
PATHS = r"(?i)(test|example|doc|sample|mock|fixture)"
#: One or more vowels after at most three consonants, as in words that can be spoken.
SYLLABLE = r"(?i)[b-df-hj-np-tv-z]{0,3}[aeiouy]{1,3}"
FEATURES = ("length", "transitions", "digits", "uppers", "marks", "hex", "distinct", "coverage", "syllables", "telling", "harmless", "path", "assigned")


def dictionary_pattern(dictionary: tuple[str, ...]) -> str:
    return "(?i)(" + "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) + ")"


CHANGE = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
HEX = r"^([0-9a-f]+|[0-9A-F]+)$"
ASSIGNS = r"[=:]\s*[\"']?$"


def _features(c: Column, before: Column, near: Column, after: Column, path: Column, dictionary: tuple[str, ...] = DICTIONARY) -> list[Column]:
    """The features of candidate ``c``: text of its word before it, the two words before, the word after, and the path."""
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    covered = lambda pattern: 1 - F.length(F.regexp_replace(c, pattern, "")) / n
    context = F.concat_ws(" ", near, before)
    yes = lambda b: b.cast("int").cast("double")
    return [
        n,
        share(CHANGE),
        share("[0-9]"),
        share("[A-Z]"),
        share(r"[^A-Za-z0-9]"),
        yes(c.rlike(HEX)),
        F.size(F.array_distinct(F.split(c, ""))) / n,
        covered(dictionary_pattern(dictionary)),
        covered(SYLLABLE),
        yes(context.rlike(TELLING)),
        yes(F.concat_ws(" ", context, after).rlike(HARMLESS)),
        yes(path.rlike(PATHS)),
        yes(context.rlike(ASSIGNS)),
    ]


@dataclass
class Forest:
    """Trees as nested tuples (feature, cut, below or equal, above), leaves as the share of secrets."""

    trees: list

    def column(self, x: list[Column]) -> Column:
        def tree(t) -> Column:
            return F.when(x[t[0]] <= F.lit(float(t[1])), tree(t[2])).otherwise(tree(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        return sum(map(tree, self.trees[1:]), tree(self.trees[0])) / len(self.trees)

    def predict(self, row: list[float]) -> float:
        def walk(t) -> float:
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        return sum(map(walk, self.trees)) / len(self.trees)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 6, leaf: int = 5, seed: int = 11) -> Forest:
    """Bootstrap samples, a random third of the features at each split, Gini impurity; deterministic."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, level: int):
        p = float(y[rows].mean())
        if level == depth or len(rows) < 2 * leaf or p in (0.0, 1.0):
            return round(p, 6)
        best = None
        for f in rng.permutation(x.shape[1])[: max(2, x.shape[1] // 3)]:
            values = np.unique(x[rows, f])
            cuts = (values[:-1] + values[1:]) / 2
            for cut in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0.02, 0.98, 24)):
                below = x[rows, f] <= cut
                n = int(below.sum())
                if leaf <= n <= len(rows) - leaf:
                    a, b = y[rows][below].mean(), y[rows][~below].mean()
                    cost = n * a * (1 - a) + (len(rows) - n) * b * (1 - b)
                    if best is None or cost < best[0]:
                        best = (cost, int(f), round(float(cut), 6), below)
        if best is None:
            return round(p, 6)
        return (best[1], best[2], grow(rows[best[3]], level + 1), grow(rows[~best[3]], level + 1))

    return Forest([grow(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)])


_HEX, _UPPER, _LOWER, _DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
SECRET_KINDS = ("hex", "alphanumeric", "prefixed", "base64", "web token", "upper case", "password")
HARMLESS_KINDS = ("long word", "capitals", "digest", "uuid", "url", "placeholder", "identifier", "number", "rule", "encoded data", "setting")


def labelled_findings(n: int = 3000, seed: int = 5, kinds: tuple[str, ...] = SECRET_KINDS + HARMLESS_KINDS) -> list[tuple[str, str, str, str, str, int, str]]:
    """Findings (before, near, candidate, after, path, label, kind) drawn by rule: secrets in code, settings and prose, and what
    scanners wrongly report - digests, identifiers, URLs, placeholders, encoded data, settings and long words.

    Words are put together from consonants and vowels by rule, not taken from any corpus. Secrets and others come in turn.
    """
    r = random.Random(seed)
    draw = lambda letters, k: "".join(r.choices(letters, k=k))
    onsets, nuclei, codas = "b br c ch cl d dr f fl g gr h j k l m n p pl pr qu r s sh sl st str t th tr v w".split(), "a a e e e i i o o u ea ai ou ie oo".split(), ["", "", "", *"n r s t l m nd st ng nt rs ck".split()]
    word = lambda low, high: "".join(r.choice(onsets) + r.choice(nuclei) + r.choice(codas) for _ in range(r.randint(low, high)))
    secrets, others = [k for k in kinds if k in SECRET_KINDS], [k for k in kinds if k in HARMLESS_KINDS]
    names = ["token", "secret", "api_key", "password", "auth_token", "access_key", "client_secret", "private_key", "pwd"]
    out = []
    for i in range(n):
        plain, path, after = f"{word(1, 3)} {word(1, 3)}", r.choice(["src0", "src4", "web", "app/main.py", "config/prod.env", "docs/readme.md", "tests/test_api.py"]), word(1, 3)
        if secrets and (i % 2 or not others):
            kind = secrets[i // 2 % len(secrets)]
            value = {
                "hex": lambda: draw(_HEX, r.choice([24, 32, 40, 64])),
                "alphanumeric": lambda: draw(_ALNUM, r.randint(16, 48)),
                "prefixed": lambda: r.choice(["sk_live_", "ghp_", "xoxb-", "glpat-", "AKIA"]) + draw(_ALNUM, r.randint(16, 36)),
                "base64": lambda: draw(_ALNUM + "+/", r.choice([40, 44, 64, 88])) + r.choice(["", "=", "=="]),
                "web token": lambda: "eyJ" + draw(_ALNUM + "_-", r.randint(30, 90)),
                "upper case": lambda: draw(_UPPER + "234567", r.randint(16, 32)),
                "password": lambda: "".join(r.sample(draw(_ALNUM, r.randint(6, 12)) + draw("!@#$%&*.?-_", r.randint(1, 4)) + draw(_DIGITS, 2), k=9)),
            }[kind]()
            name = r.choice(names)
            near, before = r.choice([(f"{name} =", '"'), (f"{word(1, 2)} {name}:", '"'), (f"{word(1, 2)} {name}:", ""), (plain, f'{name}="'), (f"{name} :", "'"), (f"export {name.upper()}", f"{name.upper()}=")])
            if kind != "password" and r.random() < 0.15:
                near, before = f"{word(1, 2)} Bearer", ""
            if kind in ("prefixed", "web token") and r.random() < 0.5:
                near, before = plain, ""
            out.append((before, near, value, after, path, 1, kind))
            continue
        kind, before, near = others[i // 2 % len(others)], "", plain
        if kind == "long word":
            value = (word(7, 11) + draw(_LOWER, 16))[: r.randint(16, 30)] if r.random() < 0.1 else word(7, 11)
        elif kind == "capitals":
            value = word(7, 11).upper()
        elif kind == "digest":
            near, value = f"{word(1, 2)} {r.choice(['sha256:', 'commit', 'md5', 'checksum =', 'revision', 'digest:', 'etag:'])}", draw(_HEX, r.choice([32, 40, 64]))
        elif kind == "uuid":
            value = "-".join(draw(_HEX, k) for k in (8, 4, 4, 4, 12))
        elif kind == "url":
            before, value = r.choice(["https:", "http:"]), f"//{word(1, 2)}/{word(2, 3)}/{word(2, 3)}/{r.randint(1, 999)}"
        elif kind == "placeholder":
            name = r.choice(names)
            near, value = f"{name} =", r.choice([f"your_{name}_goes_here", f"example-{name}-value", "x" * r.randint(16, 24), f"sample_{name}_value", "0" * r.randint(16, 32), f"test_user_{name}_name", "change_me_" + word(2, 3), "<" + name + "-here>"])
        elif kind == "identifier":
            value = "_".join(word(1, 2) for _ in range(r.randint(3, 5)))
        elif kind == "number":
            near, value = f"{word(1, 2)} {r.choice(['number', 'id', 'tel', ''])}", draw(_DIGITS, r.randint(16, 20))
        elif kind == "rule":
            value = r.choice(["=", "-", "_"]) * r.randint(16, 60)
        elif kind == "encoded data":
            near, value = r.choice(["data base64", "image src", "integrity sha512", "font encoded"]), draw(_ALNUM + "+/", r.randint(60, 200))
        else:
            near, value = r.choice([f"{word(1, 2)} auth:", "token :", "password:", "secret =", f"{word(1, 2)} credentials:"]), r.choice([word(4, 6), f"{word(2, 3)}.{word(2, 3)}", f"{word(2, 3)}-{word(2, 3)}", f"{word(2, 3)}/{word(2, 3)}", f"get_{word(2, 4)}()"])
        if len(value) < 8 or kind not in ("placeholder", "setting") and len(value) < 16:
            value += word(6, 8).upper() if kind == "capitals" else word(6, 8)
        out.append((before, near, value, after, path, 0, kind))
    return out


@cache
def _forest(application: str, n: int, seed: int, kinds: tuple[str, ...]) -> Forest:
    return fit_on(SparkSession.getActiveSession(), labelled_findings(n, seed, kinds))


def fit_on(spark: SparkSession, findings: list[tuple], **options) -> Forest:
    """A forest fitted on labelled findings as :func:`labelled_findings` gives them; their number is the caller's."""
    names = ("before", "near", "candidate", "after", "path", "label", "kind")
    rows = spark.createDataFrame(findings, ", ".join(f"{k} {'int' if k == 'label' else 'string'}" for k in names))
    got = rows.select(*_features(*(F.col(k) for k in ("candidate", "before", "near", "after", "path"))), "label").collect()
    data = np.array([tuple(r) for r in got], float)
    return fit_forest(data[:, :-1], data[:, -1], **options)


def default_forest(spark: SparkSession, n: int = 3000, seed: int = 5, kinds: tuple[str, ...] = SECRET_KINDS + HARMLESS_KINDS) -> Forest:
    """The forest fitted on :func:`labelled_findings`, fitted once for an application."""
    return _forest(spark.sparkContext.applicationId, n, seed, kinds)


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """One row per input row: id and ``findings``, an array of (position, candidate, score, secret) for the whole text.

    A candidate is a run of at least 16 letters, digits and ``+/_=-``, or what is assigned to a telling name (token, password
    and the like) from 8 characters on, up to a quote, comma or semicolon; position counts words from 0. The forest judges each.
    Only built-in expressions run, nothing is shuffled. Null texts and texts without candidates have an empty array; a null path
    is an empty one; repeated rows are scanned each on their own; other columns are not looked at.
    """
    base = docs.select(F.col(id_col), F.split(text_or_empty(text_col), BLANKS).alias("_words"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("_path"))
    words = F.col("_words")
    at = lambda i: F.coalesce(F.get(words, i), F.lit(""))
    near = lambda i: F.concat_ws(" ", at(i - 2), at(i - 1))
    ends = lambda w: w.endswith("=") | w.endswith(":") | w.endswith("=\"") | w.endswith(":\"") | w.endswith("='") | w.endswith(":'")
    assigns = lambda i: ends(at(i - 1)) & near(i).rlike(TELLING)
    marked = lambda w: (w.contains("=") | w.contains(":")) & w.rlike(ASSIGNED)
    test = lambda i, w: (F.octet_length(w) >= 8) & ((F.octet_length(w) >= 16) & w.rlike(CANDIDATE) | marked(w) | assigns(i))
    hits = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: test(i, F.get(words, i)))

    def found_in(i: Column) -> Column:
        word, group = F.get(words, i), F.lit(1)
        following = F.when(assigns(i), F.regexp_extract_all(word, F.lit(FOLLOWING), group)).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.regexp_extract_all(word, F.lit(CANDIDATE), F.lit(0)), F.regexp_extract_all(word, F.lit(ASSIGNED), group), following))

    found = F.flatten(
        F.transform(
            hits,
            lambda i: F.transform(found_in(i), lambda c: F.struct(i.alias("position"), c.alias("candidate"), F.call_function("substring_index", at(i), c, F.lit(1)).alias("before"), near(i).alias("near"), at(i + 1).alias("after"))),
        )
    )
    measured = F.transform(
        F.col("_found"),
        lambda x: F.struct(x["position"].alias("position"), x["candidate"].alias("candidate"), *[v.alias(k) for k, v in zip(FEATURES, _features(x["candidate"], x["before"], x["near"], x["after"], F.col("_path")), strict=True)]),
    )
    scored = F.transform(F.col("_measured"), lambda x: F.struct(x["position"].alias("position"), x["candidate"].alias("candidate"), forest.column([x[k] for k in FEATURES]).alias("score")))
    judged = F.transform(F.col("_scored"), lambda x: F.struct(x["position"].alias("position"), x["candidate"].alias("candidate"), F.round(x["score"], 6).alias("score"), (x["score"] >= threshold).alias("secret")))
    return base.select(id_col, "_path", found.alias("_found")).select(id_col, measured.alias("_measured")).select(id_col, scored.alias("_scored")).select(id_col, judged.alias("findings"))
