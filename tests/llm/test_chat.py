import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import chat

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/", "s>", "INST]", " ", "\n", "a", "é"]
ROLES = [None, "", "user", "assistant", "system", "tool", "[/ROLE] x", "<s>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(ROLES), st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), max_size=5))
def test_round_trip(turns):
    parser, found, formatted = chat.TurnParser(), [], ""
    for role, text in turns:
        segment, start, end = chat.format_turn(role, text)
        assert chat.unescape(segment[start:end]) == text
        formatted += segment
    found = [t[:2] for t in parser.feed(formatted)]
    assert parser.complete and found == [(role or "", text) for role, text in turns]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=15).map("".join))
def test_escape_is_reversible_and_hides_control_strings(text):
    shown = chat.escape(text)
    assert chat.unescape(shown) == text and not chat._BARE.search(shown)


def test_plain_text_stays_as_it_is():
    assert chat.format_turn("user", "a < b [c] \\s>")[0] == "<s>[INST] a < b [c] \\s> [/INST]"


def test_conversations(spark):
    says = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", says, 1), (-7, 1, "assistant", says, 1), (1, 2, "assistant", None, 1), (1, 1, None, "x", 1), (1, 1, None, "x", 1), (None, 0, "user", "z" * 100_000, 1), (2, None, "assistant", "first", 1), (2, 0, "user", "", 1)]
    rows += [(9, i, random.choice(["user", "assistant"]), f"turn {i}", 1) for i in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    by = {}
    for c, turn, role, text, _ in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        answers = "".join(t[3] for t in turns if t[2] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(answers), sha(answers))
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0
