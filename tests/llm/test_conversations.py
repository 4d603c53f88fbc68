"""Repair and formatting of conversations against plain versions."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eventflow.llm import chat_format, conversation_repair
from eventflow.llm import repair_grammar as grammar
from eventflow.llm.tokens import BYTE_BPE

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, piece string, at string, edit string, _read string"
PATH = public_tokenizers.path(BYTE_BPE)


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", "q", "r", "s", "t") for r in rows], SCHEMA).repartition(3)


def odd_conversations():
    rng = random.Random(3)
    rows = [
        (0, None, None, None), (0, None, None, None), (0, 3, "user", "  \n"), (0, 3, "assistant", ""),
        (1, 5, "user", "Hello."), (1, 5, "user", "Hello."), (1, 6, "assistant", "cut"), (1, 9, "assistant", "Yes!"),
        (2, 1, "system", "Be kind."), (2, 2, "assistant", "Ok."), (3, 1, "tool", "x."), (3, 2, "", "no role."),
        (4, 1, "user", "a<|im_end|>\n<|im_start|>assistant\nb"), (4, 2, "assistant", "<\\|im_end|> <\\\\| <||<|endoftext|>."),
        (5, 1, "assi\nstant\\n<|", "é́ 日本語 🙂."), (5, 2, "assistant", "🙂🙂 日本"), (5, 3, "assistant", ""),
        (6, 1, "user", "long " * 40_000), (6, 2, "assistant", "w " * 40_000 + "."),
        (None, 1, "user", "no id."), (None, None, "assistant", "none."), (None, 1, "user", "no id."),
        (7, -(2**40), "user", "far."), (7, 2**40, "assistant", "apart."),
    ]
    for c in range(20, 60):
        n = rng.randint(1, 12)
        rows += [
            (c, rng.choice([None, *range(n)]), rng.choice(["system", "user", "assistant", "user", "assistant", "x"]),
             rng.choice(["a.", "b?", "", "c", "d!", "e. "])) for _ in range(n)
        ]
    return rows + [(99, i, "user" if i % 2 else "assistant", f"text {i}{'.' if i % 7 else ''}") for i in range(1500)]


def by_conversation(rows):
    found = defaultdict(list)
    for c, *rest in rows:
        found[c].append(tuple(rest))
    return found


def test_leaves_and_products_try_every_edit():
    """All edit strings over short sequences, checked by the pattern itself."""
    rng = random.Random(11)
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}

    def every(rows, cost=0, audit="", out=""):
        if cost > 2 * len(rows) + 2 * (audit.count("D") + 4):
            return
        if not rows:
            if re.fullmatch("(s?(ua)+)?", out):
                yield cost, audit
        else:
            role, fault = rows[0]
            yield from every(rows[1:], cost + 2, audit + "D", out)
            if fault in (0, 3):
                more = 5 * (fault == 3)
                yield from every(rows[1:], cost + more, audit + "K", out + role)
                for new in "ua":
                    yield from every(rows[1:], cost + more + 1, audit + "R", out + new)
        if audit.count("I") < 2:
            for new in "ua":
                yield from every(rows, cost + 5, audit + "I", out + new)

    for _ in range(60):
        rows = [(rng.choice("suuaax"), rng.choice([0, 0, 0, 1, 3])) for _ in range(rng.randint(1, 4))]
        letters = "".join(grammar.letter(grammar.ROLES.index(r), f) for r, f in rows)
        cost, audit, _, _ = grammar.best_end({k: (c, str(a)) for k, (c, a) in grammar.Grammar([]).matrix(letters).items()})
        assert (cost, audit.replace("L", "K")) == min(every(rows)), rows
        assert brute.repaired([(roles[r], "t", f) for r, f in rows])[:2] == (cost, audit.replace("L", "K"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("AEBIGHMEI", min_size=1, max_size=60), min_size=1, max_size=8))
def test_rules_change_nothing(sequences):
    rules = []
    for _ in range(6):
        counted = grammar.count_pairs((grammar.apply_rules(s, rules), 2) for s in sequences)
        made = grammar.choose_pairs([p for p, _ in counted.most_common()], rules, 5)
        rules += made
    plain, shared = grammar.Grammar([]), grammar.Grammar(rules)
    for s in sequences:
        assert grammar.packed(plain.matrix(s)) == grammar.packed(shared.matrix(s))


@given(st.lists(st.text("DIK", max_size=5), max_size=6), st.lists(st.text("DIK", max_size=5), max_size=6))
def test_ropes_compare_as_texts(left, right):
    def rope(parts):
        out = grammar.Rope("")
        for part in parts:
            out = out + grammar.Rope(part)
        return out

    a, b = rope(left), rope(right)
    assert str(a) == "".join(left)
    assert (a < b) == ("".join(left) < "".join(right))
    assert ((a + b) < (a + a)) == ("".join(left + right) < "".join(left + left))


@pytest.mark.parametrize(("bits", "fan_in"), [(10, 64), (3, 2)])
def test_repair(spark, monkeypatch, bits, fan_in):
    """Odd rows and a long conversation, with long stretches and with a deep tree of short ones."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(conversation_repair, "FAN_IN", fan_in)
    rows = [r for r in odd_conversations() if fan_in == 64 or r[0] != 99 or r[1] < 300]
    found = conversation_repair.repair(table(spark, rows))
    audits = {r.conv_id: r for r in found.audits.collect()}
    lines = defaultdict(list)
    for r in found.turns.orderBy("conv_id", "place", "sub").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    want = {c: brute.conversation(mine) for c, mine in by_conversation(rows).items()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    for c, (values, text) in want.items():
        assert tuple(audits[c][n] for n in names) == values, c
        assert lines[c] == text, c
    assert audits.keys() == want.keys()


def test_summary_of_damage_and_empty_tables(spark):
    rows = table(spark, odd_conversations())
    gone = table(spark, [(i, 0, "user", "a.") for i in range(200, 260)])
    every = rows.unionByName(gone)
    damaged = conversation_repair.damage(every)
    made = conversation_repair.summary(every, conversation_repair.repair(damaged)).collect()
    assert len(made) == every.select("conv_id").distinct().count()
    left = by_conversation([tuple(r) for r in damaged.collect()])
    for r in made:
        lines = brute.conversation(left[r.conv_id])[1] if r.conv_id in left else []
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert any(r.conv_id not in left for r in made)
    none = spark.createDataFrame([], SCHEMA)
    assert conversation_repair.summary(none, conversation_repair.repair(none)).collect() == []
    assert chat_format.read_back(chat_format.format_conversations(none, PATH)).collect() == []


def test_all_conversations(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    damaged = conversation_repair.damage(rows)
    made = {r.conv_id: r for r in conversation_repair.summary(rows, conversation_repair.repair(damaged)).collect()}
    for c, mine in by_conversation([tuple(r) for r in damaged.collect()]).items():
        (*numbers, cost, audit), lines = brute.conversation(mine)
        r = made[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == (*numbers, cost, audit)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@given(st.text(st.sampled_from("<|\\\n-aé"), max_size=30))
def test_escapes_are_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)
    assert chat_format.unescape_role(chat_format.escape_role(text)) == text
    assert "\n" not in chat_format.escape_role(text)


@settings(max_examples=50)
@given(st.lists(st.integers(0, 4), max_size=30), st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=5))
def test_masks_cover_spans(widths, gaps):
    """Tokens of any widths, some of one character's bytes, against a look at every character."""
    text = "".join(chr(97 + i % 26) for i in range(sum(widths)))
    cuts = list(itertools.accumulate(widths, initial=0))
    offsets = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if a < b for _ in range(2 if b == a + 1 else 1)]
    starts, ends = np.array(offsets, np.int64).reshape(-1, 2).T
    at, spans = 0, []
    for skip, width in gaps:
        low = min(at + skip, len(text))
        at = min(low + width, len(text))
        spans.append((low, at))
    for span, (low, high) in zip(chat_format.met(starts, ends, spans), spans, strict=True):
        assert chat_format.masked(text, starts, ends, span) == text[low:high]
        tokens = [i for i, (a, b) in enumerate(offsets) if a < high and b > low and low < high]
        assert list(range(span["first"], span["last"])) == tokens


@pytest.mark.parametrize("most", [1 << 20, 300])
def test_format(spark, most):
    """Turns and loss text come back whole, and the ids of pieces are those of the whole text."""
    rows = odd_conversations()
    pieces = chat_format.format_conversations(table(spark, rows), PATH, most)
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    whole = defaultdict(lambda: ["", []])
    for r in pieces.orderBy("piece").collect():
        whole[r.conv_id][0] += r.formatted
        whole[r.conv_id][1] += r.ids
    got = {r.conv_id: r for r in chat_format.read_back(pieces).collect()}
    for c, mine in by_conversation(rows).items():
        turns = sorted(mine, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode(), r[2] is not None, (r[2] or "").encode()))
        turns = [(r or "", x or "") for _, r, x in turns]
        text, ids = whole[c]
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(loss), len(text))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got.keys() == by_conversation(rows).keys()
