"""Languages of documents and of their passages by cross-parsing entropy (problem 9).

Per language a suffix automaton of labelled text is built. A passage is parsed against each
automaton into phrases, each the longest that the labelled text contains; the language that needs
the fewest phrases, normalised by length and by the size of its text, wins.

The automata are fitted on a bounded sample of labelled rows (``SAMPLE_DOCS`` per language,
``SAMPLE_CHARS`` of distinct sentences each), cleaned of wrong labels by parsing each sentence
against the other languages once. Every sentence of every document is then parsed in full.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Documents of one label, and share of them, in which a sentence must stand to be trusted without being
#: parsed; more than the edited copies of one mislabelled document make.
FIRM_VOTES, FIRM_SHARE = 3, 0.02
#: Small models that judge the labels of the sample, and letters per language that each is made of.
JUDGES, JUDGE_CHARS = 5, 4000
#: A sentence is safe if its label's language needs at most this part of the phrases of any other,
#: and at most so many of its document's sentences are not.
SAFE, MOST_UNSAFE = 0.8, 0.2
#: Letters and words that a full sentence has at least, for its language to be decided on its own.
MIN_LETTERS, MIN_WORDS = 10, 3
#: The runner-up needs so many times the winner's phrases, else a sentence follows its neighbours.
MARGIN = 1.2
#: A passage without sentence marks is parsed in pieces of so many words if it is longer than LONG_WORDS.
LONG_WORDS, PIECE_WORDS = 36, 5
#: Letters that are parsed one after the other; longer passages are cut there.
SLICE = 1000
#: Cost of a change of language between pieces, in phrases.
SWITCH = 6.0

# Language labels in their conventions, regions and scripts cut off, lower case.
LABELS = {
    "en": "en eng english englisch anglais",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands",
    "sv": "sv swe swedish svenska",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
}
# Labels that name no language.
NO_LANGUAGE = "- -- ? n/a na none null und unknown unk xx xxx zxx mul mis other"

LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
# Letters that decomposition does not reduce to base letters.
PLAIN = {"ß": "ss", "ł": "l", "ø": "o", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ё": "е"}

# The short i is a letter of its own, not one with a mark, and is put back after decomposition.
_PLAIN = str.maketrans(PLAIN | {"й": "\ufffe"})
#: Blocks of combining marks.
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0487\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]+")
_LETTERS = re.compile("[a-zа-я]+")

_CODE = {c: i + 1 for i, c in enumerate(LATIN)} | {c: i + 27 for i, c in enumerate(CYRILLIC)}
_TO_CODE = str.maketrans({c: chr(i) for c, i in _CODE.items()} | {" ": "\0"})
_BY_LABEL = {w: code for code, words in LABELS.items() for w in words.split()}
#: Marks of a list item, a speaker or a time at the start of a line; lines of noise hold too few letters.
_LEAD = re.compile(r"^\s*(?:[-*•]+\s+|[A-Z]:\s+|a:\s+|b:\s+|\[[\d:.]+\]\s*|<[\d:.]+>\s*)*")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'”»)]*+\s+|\n+")
_NOISE = re.compile(r"&=\S+|\[[^\]\n]{0,40}\]|<[^>\n]{0,40}>|\([^)\n]{0,40}\)")
#: Words with digits, addresses, names joined twice, and the marks of unintelligible speech are no language.
_MAYBE_NO_WORD = re.compile(r"[\d@]|[-_]|(?i:xxx|yyy|www)")
_NO_WORD = re.compile(r"[\d@]|[-_].*[-_]|^(?i:xxx|yyy|www)[.,;:]?$")


def label_code(label: str | None) -> str | None:
    """Two-letter code of a label in any of the conventions; None if it names no language; '?' for another language."""
    if not isinstance(label, str):
        return None
    w = label.strip().lower()
    if not w or w in NO_LANGUAGE.split():
        return None
    return _BY_LABEL.get(w) or _BY_LABEL.get(re.split(r"[-_.@( ]", w)[0]) or "?"


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were once read as a one-byte code, read rightly; other text unchanged."""
    if not re.search("[ÃÂÅÄÐÑ][\u0080-\u00bf\u2018-\u2122\u0152-\u017e\u0192\u02c6\u02dc€]", text):
        return text
    def fix(m: re.Match) -> str:
        for code in ("cp1252", "latin-1"):
            try:
                return m.group(0).encode(code).decode("utf-8")
            except UnicodeError:
                pass
        return m.group(0)
    return re.sub(r"[^\x00-\x7f]+", fix, text)


def folded(text: str) -> str:
    """Lower-case base letters and single spaces only; accents, digits and marks are dropped."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFD", t.translate(_PLAIN))
        t = _MARKS.sub("", t).replace("\ufffe", "й")
    return " ".join(_LETTERS.findall(t))


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, folded text) of all lines and sentences; those without letters are left out."""
    out, at = [], 0
    for m in [*_SENTENCE.finditer(text), None]:
        end = m.end() if m else len(text)
        raw = text[at:end]
        kept = _NOISE.sub(" ", _LEAD.sub("", repaired(raw)))
        if _MAYBE_NO_WORD.search(kept):
            kept = " ".join(w for w in kept.split() if not _NO_WORD.search(w))
        body = folded(kept)
        if body:
            out.append((at, at + len(raw.rstrip()), body))
        at = end
    return out


class Automaton:
    """Suffix automaton of a text, as a dense table of steps for vectorised parsing."""

    def __init__(self, text: str):
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in (_CODE.get(x, 0) for x in text):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        used = sorted({c for d in nxt for c in d})
        self.columns = np.full(len(_CODE) + 1, len(used), np.int32)  # letters that never occur share a column of mismatches
        self.columns[used] = np.arange(len(used))
        back = {c: i for i, c in enumerate(used)}
        width = len(used) + 1
        table = np.full((len(nxt), width), -1, np.int32)
        for s, d in enumerate(nxt):
            for c, t in d.items():
                table[s, back[c]] = t
        # An entry is where the next state's row starts, times two, and one more if a phrase starts with this
        # letter: at the root, where no phrase is open, and wherever the text does not go on.
        starts = table < 0
        starts[0] = True
        self.steps = (np.where(starts, np.maximum(table[0], 0), table) * (2 * width) + starts).ravel()
        self.bits = math.log2(max(2, len(text)))

    def phrases(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of phrases of each column of ``codes`` (letters x texts, padded; ``lengths`` descending), all side by side.

        A phrase is counted where it starts; a letter that the text lacks is a phrase of its own.
        """
        n = len(lengths)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        cols = self.columns[codes]
        open_ = np.searchsorted(-lengths, -np.arange(len(codes)), side="left").tolist()  # texts longer than t
        for t, m in enumerate(open_):
            step = self.steps.take(state[:m] + cols[t, :m])
            count[:m] += step & 1
            np.right_shift(step, 1, out=state[:m])
        return count


@dataclass
class Model:
    codes: list[str]
    automata: list[Automaton]

    def costs(self, texts: list[str], cells: int = 1 << 21) -> np.ndarray:
        """Bits per letter that each text needs in each language: phrases times log2 of the labelled text's size.

        Repeated texts are parsed once; texts of like length are parsed together, ``cells`` letters at a
        time. Texts above ``SLICE`` letters are parsed in slices, which adds at most a phrase each.
        """
        index: dict[str, int] = {}
        where = [index.setdefault(t, len(index)) for t in texts]
        slices = sorted(((t[a : a + SLICE], r) for t, r in index.items() for a in range(0, len(t), SLICE)), key=lambda x: -len(x[0]))
        out = np.zeros((len(index), len(self.codes)))
        s = 0
        while s < len(slices):
            part = slices[s : s + max(1, cells // len(slices[s][0]))]
            lengths = np.array([len(t) for t, _ in part])
            codes = np.zeros((len(part), int(lengths[0])), np.uint8)
            for r, (t, _) in enumerate(part):
                codes[r, : lengths[r]] = np.frombuffer(t.translate(_TO_CODE).encode("latin-1", "replace"), np.uint8)
            codes = np.ascontiguousarray(codes.T)
            rows = np.array([r for _, r in part])
            for k, a in enumerate(self.automata):
                np.add.at(out[:, k], rows, a.phrases(codes, lengths))
            s += len(part)
        size = np.array([max(1, len(t)) for t in index])[:, None]
        return (out * np.array([a.bits for a in self.automata]) / size)[where]


def _chosen(parts: list[str], chars: int, novel_first: bool) -> str:
    """Up to ``chars`` letters of text; with ``novel_first`` sentences of mostly new word pairs go before the others."""
    seen: set[tuple[str, str]] = set()
    new, rest = [], []
    for p in parts:
        words = p.split(" ")
        pairs = set(zip(["", *words], [*words, ""]))
        (new if novel_first and 2 * len(pairs - seen) >= len(pairs) else rest).append(p)
        seen |= pairs
    taken, n = [], 0
    for p in new + rest:
        if n > chars:
            break
        taken.append(p)
        n += len(p) + 1
    return " ".join(taken)


def fit(rows: list[tuple[str, str]], chars: int = SAMPLE_CHARS) -> Model:
    """Model from (label code, text) rows.

    A sentence counts for the language that most of its documents are labelled with. Those that
    stand in few documents are then parsed by ``JUDGES`` small models, each of other documents;
    where, in the median, another language needs fewer phrases, the label is taken for wrong, and
    where it needs hardly more, the sentence is used only if there is too little safe text. Small
    models judge best here: what little mislabelled text each holds covers hardly any sentence.
    """
    votes: dict[str, Counter] = {}
    home: dict[str, tuple[int, int]] = {}  # place in its first document, and that document
    filed: set[tuple[str, ...]] = set()
    for d, (code, text) in enumerate(rows):
        said = tuple(b for _, _, b in sentences(text))
        for k, body in enumerate(dict.fromkeys(said if said not in filed else ())):  # a copy has no vote of its own
            if len(body) >= MIN_LETTERS:
                votes.setdefault(body, Counter())[code] += 1
                home.setdefault(body, (k, d))
        filed.add(said)
    size: Counter[str] = Counter()
    judge = []  # each language's documents go to the judges in turn
    for code, _ in rows:
        judge.append(size[code] % JUDGES)
        size[code] += 1
    own: dict[str, list[str]] = {}
    firm: set[str] = set()
    # All documents' first sentences come before any second one, so that a long mislabelled
    # document weighs no more than a short one.
    for body in sorted(votes, key=home.get):
        (code, n), *others = votes[body].most_common(2)
        against = others[0][1] if others else 0
        if against < n:
            own.setdefault(code, []).append(body)
        if n >= max(FIRM_VOTES, FIRM_SHARE * size[code]) and n >= 2 * against:
            firm.add(body)

    def build(parts: dict[str, list[str]]) -> Model:
        texts = {c: t for c, p in sorted(parts.items()) if (t := _chosen(p, JUDGE_CHARS, False))}
        return Model(list(texts), [Automaton(t) for t in texts.values()])

    judged = [(c, b) for c, p in own.items() for b in p if b not in firm]
    codes = sorted(own)
    costs = np.full((JUDGES, len(judged), len(codes)), np.nan)
    for h in range(JUDGES):
        model = build({c: [b for b in p if judge[home[b][1]] == h] for c, p in own.items()})
        at = [i for i, (_, b) in enumerate(judged) if judge[home[b][1]] != h]
        if at and model.codes:
            costs[np.ix_([h], at, [codes.index(c) for c in model.codes])] = model.costs([judged[i][1] for i in at])
    # Own cost against the best other language's, as the judges see it in the median.
    costs = np.where(np.isnan(costs), np.inf, costs)
    ratio: dict[str, float] = {}
    for i, (c, b) in enumerate(judged):
        seen = costs[[h for h in range(JUDGES) if judge[home[b][1]] != h], i]
        own_cost, rest = seen[:, codes.index(c)], np.delete(seen, codes.index(c), axis=1)
        others = rest.min(axis=1, initial=1e9)
        ratio[b] = float(np.median(np.minimum(own_cost, 1e9) / np.maximum(others, 1e-9)))
    unsafe, said_in = Counter(home[b][1] for b, r in ratio.items() if r > SAFE), Counter(home[b][1] for b in ratio)
    # A document with many sentences of another language is no source of safe ones either.
    safe = {b for b in votes if ratio.get(b, 0.0) <= SAFE and (b in firm or unsafe[home[b][1]] <= MOST_UNSAFE * said_in[home[b][1]])}
    texts = {}
    for c, p in sorted(own.items()):
        text = _chosen([b for b in p if b in safe], chars, True)
        if len(text) < chars:  # doubtful sentences only fill up a small sample
            text = f"{text} {_chosen([b for b in p if b not in safe and ratio.get(b, 0.0) <= 1.0], chars - len(text), False)}".strip()
        if text := text or _chosen(p, chars, True):
            texts[c] = text
    return Model(list(texts), [Automaton(t) for t in texts.values()])


def sample_labelled(docs: DataFrame, per_language: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(code, text) of at most ``per_language`` labelled documents of each of the ten languages, in hashed order.

    The window keeps only each partition's first rows before the shuffle, so nothing unbounded moves.
    """
    words = F.create_map(*[F.lit(x) for pair in _BY_LABEL.items() for x in pair])
    label = F.lower(F.trim("lang"))
    code = F.coalesce(words[label], words[F.split(label, r"[-_.@( ]")[0]])
    best = Window.partitionBy("code").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = docs.select(code.alias("code"), "doc_id", F.substring("text", 1, 20_000).alias("text")).filter("code is not null and text is not null")
    rows = rows.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= per_language).collect()
    # The fit prefers earlier rows, so their order must not depend on partitioning.
    return [(r["code"], r["text"]) for r in sorted(rows, key=lambda r: (r["code"], r["r"]))]


def _settle(parts: list[tuple[int, int, str]], cost: np.ndarray, codes: list[str]) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of one document's passages, neighbours of one language joined."""
    two = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.c_[cost[:, 0], cost[:, 0] * 2]
    best = cost.argmin(axis=1)
    sure = np.array([len(b) >= MIN_LETTERS and b.count(" ") + 1 >= MIN_WORDS for _, _, b in parts]) & (two[:, 1] >= MARGIN * two[:, 0])
    if not sure.any():
        # Nothing is decided on its own: the document's passages together decide.
        weight = np.array([len(b) for _, _, b in parts])
        whole = (cost * weight[:, None]).sum(axis=0)
        if weight.sum() < MIN_LETTERS:
            return []
        best[:] = whole.argmin()
    else:
        settled = np.flatnonzero(sure)
        here = np.arange(len(best))
        at = np.searchsorted(settled, here)
        before, after = settled[np.maximum(at - 1, 0)], settled[np.minimum(at, len(settled) - 1)]
        near = np.where(np.abs(here - before) <= np.abs(after - here), before, after)
        best = np.where(sure, best, best[near])
    # The best of the other languages: the second of all where the chosen one is the first.
    own = cost[np.arange(len(best)), best]
    other = np.where(own <= two[:, 0], two[:, 1], two[:, 0])
    sureness = np.maximum(0.0, 1.0 - own / np.where(other > 0, other, np.inf)) * (other > 0)
    out: list[list] = []
    for (s, e, b), k, conf in zip(parts, best.tolist(), sureness.tolist()):
        if out and out[-1][2] == codes[k]:
            last = out[-1]
            last[3] = (last[3] * last[4] + conf * len(b)) / (last[4] + len(b))
            last[1], last[4] = e, last[4] + len(b)
        else:
            out.append([s, e, codes[k], conf, len(b)])
    return [(s, e, c, round(float(f), 4)) for s, e, c, f, _ in out]


def _pieces(part: tuple[int, int, str]) -> list[str]:
    words = part[2].split(" ")
    return [" ".join(words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)]


def _split_long(part: tuple[int, int, str], pieces: list[str], cost: np.ndarray, model: Model) -> list[tuple[int, int, str]]:
    """A passage without sentence marks, cut where the cheapest path over its pieces changes the language."""
    phrases = cost * np.array([[len(p)] for p in pieces]) / np.array([a.bits for a in model.automata])
    total, back = phrases[0], []
    for row in phrases[1:]:
        jump = total.min() + SWITCH
        back.append(np.where(total <= jump, np.arange(len(total)), total.argmin()))
        total = np.minimum(total, jump) + row
    path = [int(total.argmin())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    path.reverse()
    out, start, span = [], 0, part[1] - part[0]
    size = max(1, sum(len(p) + 1 for p in pieces))
    for i in range(1, len(path) + 1):
        if i == len(path) or path[i] != path[start]:
            at = lambda j: part[0] + span * sum(len(p) + 1 for p in pieces[:j]) // size
            out.append((at(start), at(i), " ".join(pieces[start:i])))
            start = i
    return out


def passages(texts: list[str | None], model: Model) -> list[list[tuple[int, int, str, float]]]:
    """The passages of each text; none for null, blank and wordless texts."""
    if not model.codes:
        return [[] for _ in texts]
    parts = [sentences(t) if t else [] for t in texts]
    long = [(d, i) for d, p in enumerate(parts) for i, x in enumerate(p) if x[2].count(" ") >= LONG_WORDS]
    if long:
        cut = {k: _pieces(parts[k[0]][k[1]]) for k in long}
        cost = model.costs([x for k in long for x in cut[k]])
        at = 0
        new: dict[tuple[int, int], list] = {}
        for k in long:
            n = len(cut[k])
            new[k] = _split_long(parts[k[0]][k[1]], cut[k], cost[at : at + n], model)
            at += n
        parts = [[y for i, x in enumerate(p) for y in new.get((d, i), [x])] for d, p in enumerate(parts)]
    flat = [x[2] for p in parts for x in p]
    cost = model.costs(flat)
    out, at = [], 0
    for p in parts:
        out.append(_settle(p, cost[at : at + len(p)], model.codes) if p else [])
        at += len(p)
    return out


SEGMENTS = "doc_id long, label string, segment int, start int, end int, lang string, confidence double"


def segments(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, segment, start, end, lang, confidence) of every passage of every document.

    ``start`` and ``end`` are positions in ``text``; neighbouring passages of one language are one.
    ``label`` is the two-letter code of ``lang``, '?' for another language, null for none. Null,
    blank and wordless texts have no passage and give one row with a null ``lang``. One pass, no
    shuffle; the model is of bounded size (``SAMPLE_CHARS`` per language) and is broadcast.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or fit(sample_labelled(docs)))

    def run(batches):
        m = shared.value
        for b in batches:
            rows = []
            for i, label, found in zip(b["doc_id"], b["lang"], passages([t if isinstance(t, str) else None for t in b["text"]], m)):
                code = label_code(label)
                rows += [(i, code, k, *s) for k, s in enumerate(found)] or [(i, code, 0, None, None, None, None)]
            yield pd.DataFrame(rows, columns=["doc_id", "label", "segment", "start", "end", "lang", "confidence"])

    return docs.select("doc_id", "lang", "text").mapInPandas(run, SEGMENTS)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence, n_langs, label, mislabelled): main language of each document by passage length."""
    s = segments(docs)
    by = s.groupBy("doc_id", "label", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("confidence").alias("c"))
    d = by.groupBy("doc_id", "label").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"), F.max_by("c", F.struct("n", "lang")).alias("confidence"), F.count("lang").alias("n_langs"))
    return d.withColumn("mislabelled", ~F.col("label").eqNullSafe(F.col("lang")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own = s.filter("lang is not null").groupBy("doc_id").agg(F.max("label").alias("label"), F.collect_set("lang").alias("langs"))  # at most ten languages
    case = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return own.filter(case).select("doc_id", F.explode("langs").alias("lang"))
