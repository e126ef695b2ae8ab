import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm.peg import Grammar, GrammarError
from voxmill.llm.transcripts import parse_utterance, regular_participant


def test_ordered_choice_repetition_and_lookahead():
    g = Grammar("S <- (A / B)* !C\nA <- 'ab'\nB <- ~\"[a-b]\"\nC <- 'z'")
    tree = g.parse("abba")
    assert [n.rule for n in tree.children] == ["A", "B", "B"]
    assert g.parse("abz") is None


def test_backtracking_drops_nodes_of_failed_alternatives():
    g = Grammar("S <- A B 'x' / A A\nA <- 'a'\nB <- 'a'")
    assert [n.rule for n in g.parse("aa").children] == ["A", "A"]


def test_recursion_and_deep_nesting_do_not_crash():
    g = Grammar("S <- (P / ~\".\")*\nP <- '(' P* ')'")
    assert g.parse("(()())").children[0].rule == "P"
    assert g.parse("(" * 5000) is not None
    assert g.parse("(" * 3000 + ")" * 3000) is not None


@pytest.mark.parametrize("text", ["S <- (A", "S <- B", "S A", "S <- 'a' )"])
def test_bad_grammars_are_refused(text):
    with pytest.raises(GrammarError):
        Grammar(text)


@pytest.mark.parametrize(
    "label,letter",
    [("*A:", "A"), (" b ", "B"), ("[C]", "C"), ("SPK_B", "B"), ("spk-a", "A"), ("Speaker A", "A"), ("A:", "A"), ("", None), (None, None), ("Anna", None), ("?", None), ("A B", None)],
)
def test_labels(label, letter):
    assert regular_participant(label) == letter


@pytest.mark.parametrize(
    "tokens,words,noises,times",
    [
        (["Hello", "&=laughs", "foo@bar", "xxx", "+ing", "...", "WORLD!", None], ["hello", "world"], ["laughs"], 0),
        (["[door", "slams]"], [], ["door slams"], 0),
        (["*clears", "throat*", "[00:00:40.270]"], [], ["clears throat"], 1),
        (["<t=74.25>", "an", "early", "\x15107862_111803\x15", "12.5s", "00:01:38", "(0:05)", "100_200"], ["an", "early"], [], 6),
        (["the", "hmm", "Erm,", "&-uh", "&+ke", "XXX", "+/.", "end."], ["the", "end"], [], 0),
        (["[laughs", "(door", "slams)]"], [], ["laughs door slams"], 0),
        (["week’s", "it's"], ["week's", "it's"], [], 0),
        (["[unclosed", "word"], ["unclosed", "word"], [], 0),
        (None, [], [], 0),
        ([], [], [], 0),
        (["", None], [], [], 0),
    ],
)
def test_utterances(tokens, words, noises, times):
    assert parse_utterance(tokens) == (words, noises, times)


def test_very_long_utterance():
    words, _, _ = parse_utterance(["word", "[a", "b]", "."] * 20_000)
    assert len(words) == 20_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=8))
def test_any_tokens_parse_and_cleaning_is_stable(tokens):
    words, _, _ = parse_utterance(tokens)
    assert parse_utterance(words)[0] == [w for w in words if parse_utterance([w])[0]]


def test_a_very_long_utterance_and_wide_letters():
    words, noises, times = parse_utterance(["well ,", "uh", "it's"] * 200_000 + ["[door slams]", "12:30"])
    assert len(words) == 400_000 and set(words) == {"well", "it's"} and noises == ["door slams"] and times == 1
    assert regular_participant("＊Ａ：") == regular_participant("ａ") == "A"
