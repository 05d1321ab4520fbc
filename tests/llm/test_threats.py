import math

import pytest

from shelfmark.llm import toxicity


def paths(text, lexicon=None):
    read = toxicity.Reader(lexicon or {}).paths(text)
    return {p: round(math.expm1(x)) for p, x in zip(toxicity.PATHS, read) if x}


@pytest.mark.parametrize("text, want", [
    ("I will hurt you", "threat"), ("I will not hurt you", "negated threat"), ("he said they would kill him", "reported threat"),
    ("ich werde dich töten", "threat"), ("ich töte dich", "threat"), ("ich werde dich nicht töten", "negated threat"),
    ("je vais te tuer", "threat"), ("je te tue", "threat"), ("je ne vais pas te tuer", "negated threat"),
    ("te mato", "threat"), ("te voy a matar", "threat"), ("nunca te mataré", "negated threat"),
    ("killing you", "threat"), ("it kills you", "threat"), ("dijo que te mataría", "reported threat"),
])
def test_threats_in_either_order_and_any_form(text, want):
    assert paths(text) == {want: 1}


def test_a_threat_verb_counts_once_and_needs_a_target_in_its_clause():
    assert paths("they kill you and them") == {"threat": 1}
    assert paths("he kills time") == {"threat": 1} and paths("killing time. you wait") == {}
    assert paths("the kiln, a mate and a tuba for you") == {}


def test_a_target_on_either_side_makes_an_insult_targeted():
    lexicon = {"dolt": 2.0}
    assert paths("you dolt", lexicon) == paths("dolt that you are", lexicon) == {"targeted": 2}
    assert paths("a dolt. you wait", lexicon) == {"plain": 2}
    assert paths("not a dolt like you", lexicon) == {"negated": 2}
