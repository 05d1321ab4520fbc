import random

import pytest

from shelfmark.llm import toxicity as T

DATA = "/root/testdata/sf0.01"
#: Subjects and what they do, for sentences that hurt nobody.
PLAIN = {
    "en": (["The teacher", "My neighbour", "A small train", "Their garden", "The old clock"], [
        "is more patient today.", "travels to the coast in winter.", "discusses the path with a friend.", "was close to the track.", "made a distant sound.",
        "needs a new cover and some paint.", "will not stay here for long.", "cleared the table after dinner.", "worked for the town in spring.", "said that the weather was fine.",
    ]),
    "de": (["Der Lehrer", "Meine Nachbarin", "Ein kleiner Zug", "Unser Garten", "Die alte Uhr"], [
        "ist heute sehr ruhig.", "fährt im Winter ans Meer.", "bespricht den Weg mit einem Freund.", "war nahe an der Straße.", "machte ein leises Geräusch.",
        "braucht ein neues Dach und etwas Farbe.", "bleibt nicht lange hier.", "räumte nach dem Essen den Tisch ab.", "arbeitete im Frühling für die Stadt.", "sagte, das Wetter sei schön.",
    ]),
    "fr": (["Le professeur", "Ma voisine", "Un petit train", "Notre jardin", "La vieille horloge"], [
        "est très calme ce matin.", "part vers la mer en hiver.", "parle du chemin avec un ami.", "était près de la route.", "a fait un bruit lointain.",
        "demande un nouveau toit et de la peinture.", "ne reste pas longtemps ici.", "a rangé la table après le repas.", "travaillait pour la ville au printemps.", "a dit que le temps était beau.",
    ]),
    "es": (["El profesor", "Mi vecina", "Un tren pequeño", "Nuestro jardín", "El viejo reloj"], [
        "está muy tranquilo hoy.", "viaja a la costa en invierno.", "habla del camino con un amigo.", "estaba cerca de la calle.", "hizo un ruido lejano.",
        "necesita un techo nuevo y pintura.", "no se queda mucho tiempo aquí.", "recogió la mesa después de cenar.", "trabajaba para el pueblo en primavera.", "dijo que el tiempo era bueno.",
    ]),
}


@pytest.fixture(scope="module")
def model(spark):
    return T.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))


def scores(spark, model, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return dict(zip(texts, [r["score"] for r in sorted(T.score(rows, model).collect())]))


def test_ordinary_sentences_score_low(spark, model):
    texts = [f"{who} {what}" for subjects, acts in PLAIN.values() for who in subjects for what in acts]
    assert len(texts) == 200
    assert max(scores(spark, model, texts).values()) < 0.5
    texts = ["We discuss more travel plans, then close the clock path.", "The tractor made a more distant track clear.", "Have a nice day."]
    assert max(scores(spark, model, texts).values()) < 0.5


def test_speech_acts_decide(spark, model):
    got = scores(spark, model, ["you idiot", "not an idiot", "I will kill you.", "I will not kill you.", "He said they would kill him."])
    assert {t for t, s in got.items() if s >= 0.5} == {"you idiot", "I will kill you."}


def test_beginnings_need_more_than_one_word(model):
    assert {"idiot", "moron", "trash"} <= set(model.lexicon)
    assert not {"mor*", "tra*", "path*", "clow*", "tras*"} & set(model.lexicon)


def brute_marks(symbols):
    """Marks of each symbol, by looking back over the symbols instead of by states."""
    out = []
    for i, s in enumerate(symbols):
        marks = set()
        back = lambda span, opens, i=i: opens in symbols[max(0, i - span) : i]
        if s in (T.INSULT, T.THREAT):
            # A new cue starts its count anew, so the latest one within reach is enough.
            marks |= {"negated"} if back(3, T.NEGATION) else set()
            marks |= {"reported"} if T.REPORT in symbols[:i] else set()
        if s == T.INSULT and T.TARGET in symbols[:i]:
            marks.add("targeted")
        if s == T.TARGET and back(4, T.THREAT) or s == T.THREAT and back(4, T.TARGET):
            marks.add("threat")
        out.append(marks)
    return out


def test_composed_transducers_beside_plain_rules():
    rng = random.Random(2)
    for _ in range(3000):
        symbols = [rng.choice([T.OTHER, T.OTHER, T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT]) for _ in range(rng.randrange(1, 14))]
        state, got = 0, []
        for s in symbols:
            state, marks = T.GRAMMAR.arcs[state][s]
            got.append(set(marks))
        assert got == brute_marks(symbols), symbols


def test_ties_odd_rows_and_clashing_names(spark, model, odd):
    got = T.score(odd, model).collect()
    assert len(got) == odd.count() and len({r["score"] for r in got}) == 1
    twice = scores(spark, model, ["you idiot", "YOU IDIOT", "you  idiot "])
    assert len(set(twice.values())) == 1
    long = "The teacher travels. " * 50_000
    assert scores(spark, model, [long])[long] < 0.5
