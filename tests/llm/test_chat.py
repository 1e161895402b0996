import hashlib
import random

from marginalia.llm import chat
from marginalia.llm.chat import Turn

BITS = ["</s>", "[INST]", " ok ", "[/INST]", "\\", "\\\\", "\n", "a", "<s>", "<", "s>", "[\\INST]", "<|im_end|>", "n", "\\n\\", "é🎉"]


def text(rng, most=9):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(0, most)))


def test_escapes_are_reversible_and_total():
    rng = random.Random(1)
    for _ in range(3000):
        t = text(rng)
        assert chat.unescape(chat.escape(t)) == t
        assert not any(c in chat.escape(t) for c in chat.CONTROL)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_windows_cover_every_turn_once_and_repeat_history():
    rng = random.Random(2)
    for _ in range(1500):
        turns = [Turn(rng.choice(["user", "assistant", "system"]), text(rng), rng.randint(0, 9)) for _ in range(rng.randint(0, 14))]
        budget, history = rng.randint(3, 25), rng.randint(0, 3)
        new, masked = [], []
        for own, again, tokens in chat.windows_of(iter(turns), budget, history):
            fresh = [t for t, a in zip(own, again, strict=True) if not a]
            rest = [t for t, a in zip(own, again, strict=True) if a]
            system = turns[0].role == "system"
            assert tokens == sum(t.tokens for t in own)
            assert tokens <= budget or (len(fresh) <= 1 + system and len(rest) <= 1)
            assert len(rest) <= history + system
            assert not system or own[0] is turns[0]
            formatted, loss = chat.render(own, again)
            back = chat.read_back(formatted, [{"start": a, "end": b} for a, b in loss], again)
            new += [(r, t) for r, t, a, _ in back if not a]
            masked += [m for *_, m in back]
        assert new == [(t.role, t.text) for t in turns]
        assert "".join(masked) == "".join(t.text for t in turns if t.role == "assistant")


ROWS = [
    (1, 0, "system", "be kind"), (1, 2, "assistant", "yes"), (1, 1, "user", "hi [INST]"), (2, None, None, None), (2, 3, "assistant", "<s>" * 900),
    (None, 0, "user", "lost"), (3, 1, "user", "same"), (3, 1, "user", "same"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"),
] + [(7, k, "assistant" if k % 2 else "user", f"turn {k} " * 40) for k in range(120)]


def test_digests_against_brute_force(spark):
    frame = spark.createDataFrame([(*r, 1, "z") for r in ROWS], "conv_id long, turn long, role string, text string, window int, loss string")
    got = {r.conv_id: r for r in chat.digests(chat.format_windows(frame, budget=300)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        own = sorted((r for r in ROWS if r[0] == conv), key=key)
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars > len(loss)
    assert len(got) == len({r[0] for r in ROWS}) and got[7].n_windows > 5
    assert chat.digests(chat.format_windows(frame.limit(0))).count() == 0
