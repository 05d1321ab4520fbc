"""Toxicity by a weighted finite-state pattern grammar.

A text is cut into clauses; every word becomes a symbol: insult, threat, target, negation, reporting verb or other.
Small transducers read the symbols of a clause: ``negation`` marks what follows a negation within three words,
``reported`` what follows a reporting verb, ``target`` what follows a person spoken to or about, and
``threat`` a threat verb with a target within four words on either side.  Their composition is one table of states, so a
clause is read in one pass; each insult adds its weight to the path it was read on (plain, targeted, negated,
reported), where a target that comes later in the clause still makes a plain insult a targeted one.  Each threat verb
counts once, when its target is there, on the path that the verb was read on (threat, negated or reported threat).  A logistic
regression over the path sums and the density of plain and targeted insults and of threats gives the score.  Labels of whole documents say little
of what was negated, reported or threatened in one clause, so the weights of those paths are held near stated values (``TOWARD``,
``HOLD``), which they keep where the labelled documents never show them.

The insult lexicon is learned: words, and word beginnings of four letters and more, that stand in toxic documents far more often than
in others.  A form enters by its evidence alone: its log odds are at least ``LEAST_ODDS`` and so many documents of it are
toxic that among all forms not one in a hundred samples would be so by chance (a Chernoff bound).  A beginning must meet
this without the documents of the most frequent word that has it, so a frequent insult does not make its
neighbours in the dictionary insults.  Document frequencies are grouped aggregates over at most ``sample`` labelled documents of each
class (a documented bound, chosen by a hash of doc_id); only the forms that enter reach the driver.

Defined cases: NULL and empty texts have no clause and get the score of a text without any match.  Repeated
label rows of a document count once, as toxic if any says so.  Without labels of both classes the score is the share of
toxic labels, or 0.  Rows are scored one by one, so repeated rows, NULL ids and extra columns need no care.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm import logistic
from shelfmark.llm.common import fold_of, share_of, small_batches, written

TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, STOP = range(7)
#: Fixed cue words of the grammar (English, German, French, Spanish).
CUES = {
    TARGET: "you your he she him her they them people du dich dir dein euch ihr ihn ihm ihnen sie tu te toi vous lui elle ils usted ustedes ella ellos",
    NEGATION: "not never isn aren nicht kein keine nie ne pas jamais no nunca",
    REPORT: "said says wrote called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
}
_ER = "er|e|es|ons|ez|ent|é|ée|és|ées|ant|ais|ait|aient|erai|eras|era|erons|erez|eront|erais|erait|eraient"
_AR = "ar|o|as|a|amos|áis|an|ando|ado|ada|ados|adas|é|aste|ó|aron|aba|abas|aban|aré|arás|ará|aremos|aréis|arán|aría|arías|arían|e|es|en|emos"
#: Threat verbs as stems with their endings, whole words.
THREAT_VERB = re.compile("|".join([
    "(kill|destroy|burn)(s|ed|ing)?|burnt|hurt(s|ing)?|beat(s|en|ing)?|shoot(s|ing)?|shot|stab(s|bed|bing)?",
    "(ge)?töt(e|est|et|en|ete|etest|eten|end)|(ge)?schlagen|schlag(e|t)|schläg(st|t)|schlug(st|en)?|zerstör(e|st|t|en|te|test|ten|end)",
    f"tu({_ER})|frapp({_ER})|détrui(re|s|t|te|ts|tes|sons|sez|sent|sant|sait|rai|ras|ra|rons|rez|ront)",
    f"mat({_AR})|golpe({_AR})|destru(ir|yo|yes|ye|imos|yen|yendo|ido|ida|í|iste|yó|yeron|iré|irás|irá|iremos|irán|ya|yas|yan)",
]))
#: English words that look like a form of matar.
NO_THREAT = {"mate", "mates", "maten"}
BEGINNINGS = range(4, 9)
#: Log odds from which a form is an insult: fifty times as usual in toxic documents.
LEAST_ODDS = 4.0
CACHE = 300_000
PATHS = ("plain", "targeted", "negated", "reported", "threat", "negated threat", "reported threat")
MEASURES = len(PATHS) + 1
#: Weights that the regression starts from, and how firmly it is held there; the last is the density.
TOWARD = np.array([0.0, 0.5, 0.2, 0.2, 8.0, 0.2, 0.2, 0.0])
HOLD = np.array([1.0, 1.0, 200.0, 200.0, 50.0, 200.0, 200.0, 1.0])
DENSE = (0, 1, 4)


def forms_of(word: str) -> list[str]:
    """A word and its beginnings."""
    return [word, *(word[:k] + "*" for k in BEGINNINGS if k < len(word))]


@dataclass
class Transducer:
    """arcs[state][symbol] -> (next state, marks given to the symbol); state 0 begins."""

    arcs: list[list[tuple[int, frozenset[str]]]]


def counter(opens: int, span: int, marks: dict[int, str], forget: bool = True) -> Transducer:
    """After symbol ``opens``, the next ``span`` symbols (all, if not ``forget``) get their marks."""
    arcs = []
    for state in range(span + 1):
        row = []
        for symbol in range(STOP):
            nxt = span if symbol == opens else (max(0, state - 1) if forget else state)
            row.append((nxt, frozenset([marks[symbol]] if state and symbol in marks else [])))
        arcs.append(row)
    return Transducer(arcs)


def compose(parts: list[Transducer]) -> Transducer:
    """All at once: the states are tuples, the marks are joined; unreachable states are left out."""
    names, queue, arcs = {(0,) * len(parts): 0}, [(0,) * len(parts)], []
    for state in queue:
        row = []
        for symbol in range(STOP):
            steps = [p.arcs[s][symbol] for p, s in zip(parts, state)]
            nxt = tuple(s for s, _ in steps)
            if nxt not in names:
                names[nxt] = len(names)
                queue.append(nxt)
            row.append((names[nxt], frozenset().union(*(m for _, m in steps))))
        arcs.append(row)
    return Transducer(arcs)


GRAMMAR = compose([
    counter(NEGATION, 3, {INSULT: "negated", THREAT: "negated"}),
    counter(REPORT, 1, {INSULT: "reported", THREAT: "reported"}, forget=False),
    counter(TARGET, 1, {INSULT: "targeted"}, forget=False),
    counter(THREAT, 4, {TARGET: "threat"}),
    counter(TARGET, 4, {THREAT: "threat"}),
])


def clause_paths(symbols: list[int], weights: list[float], grammar: Transducer = GRAMMAR) -> dict[str, float]:
    """What one clause adds to each path.  A negated or reported insult or threat is on that path only."""
    out: dict[str, float] = {}
    state, waiting = 0, ""
    for symbol, weight in zip(symbols, weights):
        state, marks = grammar.arcs[state][symbol]
        if symbol == INSULT:
            path = next((p for p in ("negated", "reported", "targeted") if p in marks), "plain")
            out[path] = out.get(path, 0.0) + weight
        elif symbol == THREAT:
            waiting = next((f"{p} threat" for p in ("negated", "reported") if p in marks), "threat")
        if waiting and "threat" in marks:
            out[waiting] = out.get(waiting, 0.0) + 1.0
            waiting = ""
    if "plain" in out and TARGET in symbols:
        out["targeted"] = out.get("targeted", 0.0) + out.pop("plain")
    return out


@dataclass
class Model:
    lexicon: dict[str, float]
    regression: logistic.Logistic | None
    share: float


class Reader(dict):
    """Word -> (symbol, weight), for a lexicon; recent words are kept."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.cues = {w: (s, 0.0) for s, words in CUES.items() for w in words.split()}

    def __missing__(self, word: str) -> tuple[int, float]:
        if not word[0].isalpha():
            got = (STOP, 0.0)
        else:
            weight = max((self.lexicon.get(f, 0.0) for f in forms_of(word)), default=0.0)
            got = (INSULT, weight) if weight else self.cues.get(word, (OTHER, 0.0))
            if got[0] == OTHER and word not in NO_THREAT and THREAT_VERB.fullmatch(word):
                got = (THREAT, 0.0)
        if len(self) >= CACHE:
            self.clear()
        self[word] = got
        return got

    def paths(self, text: str | None) -> list[float]:
        """log(1 + sum) of each path over all clauses, and of the unmarked paths for a hundred words."""
        total = dict.fromkeys(PATHS, 0.0)
        read = list(map(self.__getitem__, TOKEN.findall(text.lower()))) if text else []
        hot = [i for i, (s, _) in enumerate(read) if s in (INSULT, THREAT)]
        done = -1
        for i in hot:
            if i <= done:
                continue
            first = i
            while first and read[first - 1][0] != STOP:
                first -= 1
            done = i
            while done < len(read) and read[done][0] != STOP:
                done += 1
            for path, x in clause_paths(*map(list, zip(*read[first:done]))).items():
                total[path] += x
        dense = sum(total[PATHS[k]] for k in DENSE)
        return [math.log1p(x) for x in (*total.values(), 100 * dense / max(1, len(read)))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Toxic and other documents of each form."""
    for b in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, y in zip(b["text"].to_pylist(), b["y"].to_pylist()):
            n[y].update({f for w in set(TOKEN.findall((text or "").lower())) for f in forms_of(w)})
        forms = list(n[0].keys() | n[1].keys())
        yield pa.RecordBatch.from_arrays([
            pa.array(forms, pa.string()), pa.array([n[1][f] for f in forms], pa.int64()), pa.array([n[0][f] for f in forms], pa.int64())
        ], ["form", "toxic", "other"])


def lexicon_of(train: DataFrame) -> dict[str, float]:
    """Insults and their log odds from ``train`` (text, y)."""
    sizes = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        return {}
    counted = train.select("text", F.col("y").cast("int").alias("y")).mapInArrow(_counts, "form string, toxic long, other long")
    counts = written(counted.groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")), "toxicity-forms")
    words = counts.where("toxic > 0 AND NOT endswith(form, '*')")
    # The word that most toxic documents have of those with one beginning.
    begins = F.transform(F.sequence(F.lit(BEGINNINGS[0]), F.lit(BEGINNINGS[-1])), lambda k: F.when(F.length("form") > k, F.concat(F.left("form", k), F.lit("*"))))
    top = words.select(F.explode(F.array_compact(begins)).alias("form"), F.struct("toxic", "other").alias("w")).groupBy("form").agg(F.max("w").alias("w"))
    rest = lambda c: F.col(c) - F.coalesce(F.col(f"w.{c}"), F.lit(0))
    forms = counts.where("toxic > 0").join(top, "form", "left").withColumns({"p": rest("toxic"), "n": rest("other")})
    chance = toxic / (toxic + other)
    size = F.col("p") + F.col("n")
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / size / q)).otherwise(0.0)
    odds = F.ln((F.col("p") + 0.5) / (toxic + 1)) - F.ln((F.col("n") + 0.5) / (other + 1))
    surest = part("p", chance) + part("n", 1 - chance)  # minus log of the bound for one form
    known = max(1, counts.count())
    found = forms.where("p > 0").where((odds >= LEAST_ODDS) & (surest >= math.log(100 * known))).select("form", F.least(odds, F.lit(6.0)).alias("odds"))
    return {r["form"]: r["odds"] for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """Learn from the documents whose fold isn't 0 and that ``labels`` (doc_id, toxic) names."""
    small_batches(docs.sparkSession)
    known = labels.where((fold_of("doc_id") != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy(F.col("y").cast("int").alias("y")).agg(F.count("*").alias("n")).where("y IN (0, 1)").collect()}
    if len(counts) < 2:
        return Model({}, None, float(counts.get(1, 0) > 0))
    quota = F.when(F.col("y") == 1, sample / counts[1]).otherwise(sample / counts[0])
    # About 2 * sample rows whatever the input, so they may be broadcast.
    chosen = F.broadcast(known.where("y IN (0, 1)").where(share_of(F.col("doc_id")) < quota))
    train = written(docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "y"), "toxicity-sample")
    lexicon = lexicon_of(train)
    rows = np.array([[*r["x"], r["y"]] for r in _paths(train, lexicon).collect()]).reshape(-1, MEASURES + 1)
    prior = counts[1] / (counts[0] + counts[1])
    return Model(lexicon, logistic.fit(rows[:, :-1], rows[:, -1], prior, HOLD, toward=TOWARD), prior)


def _paths(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shipped.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["y"].cast(pa.int32()), pa.array([reader.paths(t) for t in b["text"].to_pylist()], pa.list_(pa.float64()))], ["y", "x"])

    return rows.mapInArrow(run, "y int, x array<double>")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text, ...) -> doc_id, score for every row."""
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        reader = Reader(m.lexicon)
        for b in batches:
            x = np.array([reader.paths(t) for t in b["text"].to_pylist()]).reshape(-1, MEASURES)
            s = logistic.sigmoid(m.regression.logit(x)) if m.regression else np.full(len(x), m.share)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(s, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
