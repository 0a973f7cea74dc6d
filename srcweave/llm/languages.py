"""Languages of documents and of the one-language stretches inside them.

Bayesian fusion of the evidence: the likelihood of a line's words and character trigrams under naive Bayes
models, the declared label with its reliability in its place (repository and source), measured as the share of labels that agree
with the language assigned by the text, and the priors of the place, counted from the assigned languages; both are smoothed
towards repository and corpus and counted by grouped aggregation. The models start from the declared labels and are
counted once more from the lines' own assignments, which corrects wrong labels and mixed documents. Lines of a
document are then assigned together by dynamic programming with a price for a change of language.

Texts are read once: their prose lines are cleaned to words, which the later passes work on; words are scored once a batch.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcweave.session import Scratch

#: Two-letter code, three-letter codes and English name of languages that a label may name. Fixed values.
NAMES = """en eng english; de deu ger german; fr fra fre french; es spa spanish; pt por portuguese; it ita italian; nl nld dut dutch; pl pol polish; ru rus russian; tr tur turkish; ja jpn japanese; zh zho chi cmn chinese;
ar ara arabic; ko kor korean; sv swe swedish; da dan danish; no nor nob nno norwegian; fi fin finnish; cs ces cze czech; sk slk slo slovak; hu hun hungarian; ro ron rum romanian; bg bul bulgarian; uk ukr ukrainian; el ell gre greek; he heb hebrew; hi hin hindi; bn ben bengali; th tha thai; vi vie vietnamese; id ind indonesian; ms msa may malay; fa fas per persian; hr hrv croatian; sr srp serbian; sl slv slovenian; lt lit lithuanian; lv lav latvian; et est estonian; ca cat catalan; eu eus baq basque; gl glg galician; ga gle irish; is isl ice icelandic; mt mlt maltese; sq sqi alb albanian; mk mkd mac macedonian; be bel belarusian; ka kat geo georgian; hy hye arm armenian; ur urd urdu; ta tam tamil; te tel telugu; sw swa swahili; af afr afrikaans; la lat latin; fil tl tgl tagalog filipino"""
BUCKETS, SMOOTH = 1 << 16, 0.05
#: Weight of the text's log-likelihood, whose features depend on each other; price of a change of language between lines.
TEMPER, SWITCH = 0.35, 3.5
#: Texts with words that a declared language needs to be learned.
LEAST_TEXTS = 3


@lru_cache
def label_map() -> dict[str, str]:
    entries = [e.split() for e in NAMES.replace("\n", " ").split(";")]
    return {w: next((x for x in e if len(x) == 2), e[0]) for e in entries for w in e}


def label_of(raw: str | None) -> str | None:
    """Two-letter code that a label names in any spelling, or None."""
    if raw is None:
        return None
    w = re.split(r"[-_. (]", raw.strip().lower(), maxsplit=1)[0]
    return label_map().get(w)


_NOISE = re.compile(
    r"https?://\S+|`[^`]*`|<[^<>\s]{1,40}>|(?<![A-Za-z0-9_])(?:@[A-Za-z0-9_-]+|[A-Za-z0-9]*_[A-Za-z0-9_]*(?:\(\))?|[A-Za-z0-9]*[a-z][A-Z][A-Za-z0-9]*(?:\(\))?|[A-Za-z0-9_/-]+\.[a-z]{1,4}\b(?!\.\w)|[A-Za-z]*\d[A-Za-z0-9]*|[A-Za-z]+\(\)|[A-Z]{2,}\b)|"
    r"^\s*(?:feat|fix|docs|chore|refactor|test|tests|perf|style|build|ci|revert|wip)(?:\([\w -]*\))?!?:|\[[a-z_ -]+\](?!\()"
)
_WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}ー]|\p{L}+(?:['’]\p{L}+)?")
_TRACE = re.compile(r"^\s*(?:at [\w.$<>/]+\(|File \"|Traceback \(|Caused by:|\.\.\. \d+ more|goroutine \d|panic:|(?:[\w.]+\.)?\w*(?:Error|Exception)(?::|$)|\$ \S|>>> |[{}\[\]();]+\s*$|<\/?[a-z]+[^>]*>\s*$)")
_CODE = re.compile(r"^(?:\t| {4,})\S.*(?:[;{}]|\w\([^)]*\)[;:]?)\s*$|^\s*(?:let|const|var|def|func|return|import|public|private)\b.*[;({=]")


def text_lines(text: str) -> list[tuple[int, str]]:
    """(line number, text) of the lines that are prose: no code, traces or blank lines."""
    out, fence = [], False
    for n, line in enumerate(text.split("\n")):
        s = line.strip()
        if s.startswith(("```", "~~~")):
            fence = not fence
            continue
        if fence or not s or _TRACE.match(line) or _CODE.match(line):
            continue
        out.append((n, s))
    return out


_MARKS = regex.compile(r"\P{ccc=0}+")
_UPPER, _LOWER = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+")
#: Without one of these a line holds nothing that _NOISE takes out.
_SUSPECT = re.compile(r"[`<@_0-9\[]|://|[a-z][A-Z]|[A-Za-z0-9_/-]\.[a-z]|\(\)|[A-Z]{2}|^\s*[a-z]+(?:\([\w -]*\))?!?:")


def fold(text: str) -> str:
    """Entities resolved, accents off."""
    t = html.unescape(text) if "&" in text else text
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", t))


def words_of(line: str) -> list[str]:
    """The words of a line of prose in lower case, without code, names and marks of other kinds."""
    t = fold(line)
    up = sum(map(len, _UPPER.findall(t)))
    if up and up > 2 * sum(map(len, _LOWER.findall(t))):  # shouted text has no acronyms
        t = t.lower()
    return _WORD.findall((_NOISE.sub(" ", t) if _SUSPECT.search(t) else t).lower())


_HASHES: dict[str, np.ndarray] = {}


def _word_features(w: str) -> np.ndarray:
    f = _HASHES.get(w)
    if f is None:
        p = f"^{w}$"
        grams = [f"w{w}"] * 2 + ([f"t{p[i : i + 3]}" for i in range(len(p) - 2)] if len(w) > 1 else [])
        f = np.array([xxhash.xxh32_intdigest(g) % BUCKETS for g in grams], dtype=np.int32)
        if len(_HASHES) > 300_000:
            _HASHES.clear()
        _HASHES[w] = f
    return f


def line_features(line: str) -> np.ndarray:
    words = words_of(line)
    return np.concatenate([_word_features(w) for w in words]) if words else np.empty(0, dtype=np.int32)


class Batch:
    """The prose lines of several documents as word numbers over one vocabulary."""

    def __init__(self, docs: list[list[str]]):
        """``docs``: per document its lines, each the words joined by blanks."""
        lines = [x for d in docs for x in d]
        split = [x.split(" ") for x in lines]
        self.doc_lines = np.array([len(d) for d in docs])
        self.line_words = np.array([len(x) for x in split])
        flat = np.empty(int(self.line_words.sum()), dtype=object)
        flat[:] = list(chain.from_iterable(split))
        self.ids, vocabulary = pd.factorize(flat)
        parts = [_word_features(w) for w in vocabulary]
        self.sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.features = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        self.line_start = np.cumsum(self.line_words) - self.line_words
        self.doc_start = np.cumsum(self.doc_lines) - self.doc_lines

    def line_features(self) -> np.ndarray:
        """Number of features of each line."""
        return np.add.reduceat(self.sizes[self.ids], self.line_start) if len(self.line_start) else np.empty(0, dtype=np.int64)

    def scores(self, model: Model) -> np.ndarray:
        """(lines, languages): tempered log-likelihoods."""
        if not len(self.line_start):
            return np.empty((0, len(model.langs)))
        at = np.cumsum(self.sizes) - self.sizes
        word = np.add.reduceat(model.logp[:, self.features].astype(np.float64), at, axis=1).T
        return TEMPER * np.add.reduceat(word[self.ids], self.line_start, axis=0)

    def tally(self, langs: list, groups: np.ndarray) -> pd.DataFrame:
        """Feature counts by language; at bucket -1 the number of ``groups`` (one per line) with words. ``langs``: of each line, None to leave out."""
        out = []
        kind, names = pd.factorize(np.array([*langs, None], dtype=object)[:-1])
        of_word = np.repeat(kind, self.line_words)
        for k, lang in enumerate(names):
            n = np.bincount(self.ids[of_word == k], minlength=len(self.sizes))
            c = np.bincount(self.features, weights=np.repeat(n, self.sizes), minlength=BUCKETS)
            at = np.flatnonzero(c)
            out.append(pd.DataFrame({"lang": [lang] * (len(at) + 1), "bucket": np.r_[-1, at].astype(np.int32), "n": np.r_[len(np.unique(groups[kind == k])), c[at]].astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({"lang": pd.Series(dtype=object), "bucket": pd.Series(dtype=np.int32), "n": pd.Series(dtype=np.int64)})


class Model:
    """Log-probabilities of feature buckets per language, a table of fixed size."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        total = counts.sum(1, keepdims=True)
        self.logp = np.log((counts + SMOOTH) / (total + SMOOTH * BUCKETS)).astype(np.float32)
        share = total[:, 0] / max(1.0, total.sum())
        self.prior = np.log(share + 1e-3)


def _model(counted: DataFrame, least: int = 1) -> Model | None:
    t = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(t):
        return None
    texts = t[t["bucket"] < 0].set_index("lang")["n"]
    langs = sorted(texts.index[texts >= least])
    if not langs:
        return None
    counts = np.zeros((len(langs), BUCKETS))
    t = t[t["lang"].isin(langs) & (t["bucket"] >= 0)]
    counts[t["lang"].map({x: i for i, x in enumerate(langs)}), t["bucket"]] = t["n"]
    return Model(langs, counts)


def decode(scores: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Most likely language of each line, given that a change of language costs ``switch``."""
    n, k = scores.shape
    best, back = prior + scores[0], np.zeros((n, k), dtype=np.int32)
    for i in range(1, n):
        top = int(best.argmax())
        jump = best[top] - switch
        back[i] = np.where(best >= jump, np.arange(k), top)
        best = np.maximum(best, jump) + scores[i]
    out = np.empty(n, dtype=np.int32)
    out[-1] = int(best.argmax())
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i][out[i]]
    return out


def stretches(numbers: np.ndarray, scores: np.ndarray, langs: list[str], prior: np.ndarray) -> list[tuple[int, str, float]]:
    """(first line, language, confidence) of the one-language stretches of lines with ``numbers`` and ``scores``."""
    if not len(numbers):
        return []
    path = decode(scores, prior)
    out, i = [], 0
    for j in [*(np.flatnonzero(np.diff(path)) + 1), len(path)]:
        s = prior + scores[i:j].sum(0)
        p = np.exp(s - s.max())
        out.append((int(numbers[i]), langs[path[i]], float(p[path[i]] / p.sum())))
        i = j
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_cols: tuple[str, str] = ("repo", "source")) -> DataFrame:
    """(id, line_no, lang, confidence, declared): the one-language stretches of each document with text.

    Lines are counted from 0; code, traces, blank lines and lines without words belong to the stretch before them. ``declared`` is
    the two-letter code that the label names, or null. Null, empty and blank texts and those without words give no row.
    Repeated rows count once. A language needs LEAST_TEXTS labelled texts to be
    learned, whatever its share; without any such language nothing can be learned and the result is empty.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    repo, source = host_cols
    labels = F.create_map(*[F.lit(x) for kv in label_map().items() for x in kv])
    declared = F.try_element_at(labels, F.split(F.lower(F.trim(F.col(label_col))), r"[-_. (]")[0])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), declared.alias("declared"), F.coalesce(F.col(repo), F.lit("")).alias("repo"), F.coalesce(F.col(source), F.lit("")).alias("source")).where("t is not null").distinct()
    id_type = rows.schema["id"].dataType.simpleString()

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document's prose as (line number, words) and, with every batch, the tally of its labelled texts."""
        for b in batches:
            numbers, texts = [], []
            for t in b["t"]:
                found = [(n, w) for n, line in text_lines(t) if (w := words_of(line))]
                numbers.append([n for n, _ in found])
                texts.append([" ".join(w) for _, w in found])
            yield b.drop(columns="t").assign(numbers=numbers, words=texts, lang=None, bucket=None, n=None).astype({"bucket": "Int32", "n": "Int64"})
            part = Batch(texts)
            of_line = np.repeat(np.arange(len(b)), part.doc_lines)
            tally = part.tally(list(b["declared"].to_numpy(dtype=object)[of_line]), of_line)
            yield tally.assign(**{c: None for c in ("id", "declared", "repo", "source", "numbers", "words")})

    kept = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in rows.schema if x.name != "t")
    # kept, so that the texts are read once
    cleaned = scratch.keep(rows.mapInPandas(clean, f"{kept}, numbers array<int>, words array<string>, lang string, bucket int, n long"))
    first = _model(cleaned.where("bucket is not null and lang is not null").select("lang", "bucket", "n"), LEAST_TEXTS)
    if first is None:
        return spark.createDataFrame([], f"id {id_type}, line_no int, lang string, confidence double, declared string")
    shared_first = spark.sparkContext.broadcast(first)

    def count_assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each document with the language that most of its features are assigned to, and the tally of the lines."""
        m = shared_first.value
        for b in batches:
            part = Batch([list(x) for x in b["words"]])
            scores, sizes, main, found = part.scores(m), part.line_features(), [], []
            for at, k in zip(part.doc_start, part.doc_lines):
                path = decode(scores[at : at + k], m.prior) if k else np.empty(0, dtype=np.int32)
                found += [m.langs[x] for x in path]
                main.append(m.langs[int(np.bincount(path, weights=sizes[at : at + k], minlength=len(m.langs)).argmax())] if k else None)
            yield b[["id", "declared", "repo", "source", "numbers", "words"]].assign(main=main, lang=None, bucket=None, n=None).astype({"bucket": "Int32", "n": "Int64"})
            tally = part.tally(found, np.arange(len(found)))
            yield tally.assign(**{c: None for c in ("id", "declared", "repo", "source", "numbers", "words", "main")})

    docs_only = cleaned.where("bucket is null").select("id", "declared", "repo", "source", "numbers", "words")
    passed = scratch.keep(docs_only.mapInPandas(count_assigned, f"{kept}, numbers array<int>, words array<string>, main string, lang string, bucket int, n long"))
    second = _model(passed.where("bucket is not null").select("lang", "bucket", "n"))
    model = spark.sparkContext.broadcast(second or first)
    langs = (second or first).langs
    rows = passed.where("bucket is null").select("id", "declared", "repo", "source", "numbers", "words", "main")

    # languages and right labels of the place, smoothed towards the repository and the corpus
    known = rows.where(F.col("main").isin(langs))
    right = (F.col("declared") == F.col("main")).cast("long")

    def shares(keys: list[str], name: str) -> DataFrame:
        counts = known.groupBy(*keys, "main").agg(F.count("*").alias("n"), F.count("declared").alias("labels"), F.coalesce(F.sum(right), F.lit(0)).alias("right"))
        return counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("main", "n"))).alias(name), F.sum("labels").alias(f"{name}_labels"), F.sum("right").alias(f"{name}_right"))

    corpus = shares([], "all").first()
    total = corpus["all"] or {}
    placed = rows.join(shares(["repo"], "by_repo"), "repo", "left").join(shares(["repo", "source"], "by_place"), ["repo", "source"], "left")
    base = np.array([total.get(x, 0) + 1.0 for x in langs])
    base /= base.sum()
    trusted = ((corpus["all_right"] or 0) + 17) / ((corpus["all_labels"] or 0) + 20)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, at = model.value, {x: i for i, x in enumerate(langs)}

        def counts(c) -> np.ndarray:
            v = np.zeros(len(langs))
            for k, n in (c.items() if isinstance(c, dict) else c if c is not None else ()):
                v[at[k]] = n
            return v

        for b in batches:
            out = []
            part = Batch([list(x) for x in b["words"]])
            scores = part.scores(m)
            places = b[["by_repo_labels", "by_repo_right", "by_place_labels", "by_place_right"]].fillna(0).to_numpy(dtype=float)
            for i, numbers, at_line, d, g, r, p, (rn, rr, pn, pr) in zip(b["id"], b["numbers"], part.doc_start, b["declared"], b["main"], b["by_repo"], b["by_place"], places):
                repo_n, place_n = counts(r), counts(p)
                own = np.zeros(len(langs))
                if g in at:  # the document is no evidence of its own place
                    own[at[g]] = 1
                    label, hit = float(d is not None), float(d == g)
                    rn, rr, pn, pr = rn - label, rr - hit, pn - label, pr - hit
                by_repo = (np.maximum(repo_n - own, 0) + 20 * base) / (max(0, repo_n.sum() - own.sum()) + 20)
                prior = np.log((np.maximum(place_n - own, 0) + 10 * by_repo) / (max(0, place_n.sum() - own.sum()) + 10))
                if d in at:
                    right_in_place = (pr + 10 * (rr + 20 * trusted) / (rn + 20)) / (pn + 10)
                    other = max(1 - right_in_place, 1e-3) / max(1, len(langs) - 1)
                    prior += np.log(np.where(np.arange(len(langs)) == at[d], max(right_in_place, 1e-3), other))
                out += [(i, n, lang, c, d) for n, lang, c in stretches(numbers, scores[at_line : at_line + len(numbers)], langs, prior)]
            yield pd.DataFrame(out, columns=["id", "line_no", "lang", "confidence", "declared"])

    return placed.mapInPandas(assign, f"id {id_type}, line_no int, lang string, confidence double, declared string")


def mislabelled(found: DataFrame) -> DataFrame:
    """The stretches of documents whose label is absent, no language or wrong, or that hold several languages."""
    docs = found.groupBy("id").agg(F.count("*").alias("n"), F.first("lang").alias("one"), F.first("declared").alias("d"))
    wrong = docs.where((F.col("n") > 1) | F.col("d").isNull() | (F.col("d") != F.col("one"))).select("id")
    return found.join(wrong, "id", "left_semi")
