"""What the attention model of op 3 learns from, its gradients, and its scores against a pass over single ids."""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import scoring


@pytest.fixture
def blocks(monkeypatch):
    """Blocks of 40 texts, one in four held out, of one task."""
    import public_tokenizers as p

    monkeypatch.setattr(scoring, "BLOCK_ROWS", 40)
    ranks = scoring.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 300))).encode() for _ in range(160)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(160)), pa.array([i % 4 == 0 for i in range(160)]), pa.array(texts)], names=["id", "held", "text"])
    made = list(scoring._blocks(iter([rows]), SimpleNamespace(value=(ranks, p.PATTERN))))
    assert len(made) == 4
    counts = np.zeros(max(ranks.values()) + 2)
    for part in scoring._piece_counts(iter(made)):
        np.add.at(counts, part["piece"].to_numpy(), part["n"].to_numpy())
    return made, scoring.Slots(counts)


def learned(monkeypatch, made, slots, t, turn):
    """How many outcomes a task learned from in a round, and its weight."""
    counts = []
    gradients = scoring.Attention.gradients

    def counting(self, now, last, target, counted):
        counts.append(int(counted.sum()))
        return gradients(self, now, last, target, counted)

    monkeypatch.setattr(scoring.Attention, "gradients", counting)
    weight = sum(b["weight"][0].as_py() for b in scoring._train(iter(made), SimpleNamespace(value=(slots, None)), t, turn))
    monkeypatch.setattr(scoring.Attention, "gradients", gradients)
    return sum(counts), weight


def test_every_training_window_is_learned_from(monkeypatch, blocks):
    made, slots = blocks
    t = scoring.Training()
    want = sum(int(b.sizes[~b.held].sum()) for b in (scoring.Block(r, slots) for r in scoring._each(iter(made))))
    assert sum(learned(monkeypatch, made, slots, t, turn)[0] for turn in range(t.rounds)) == want


def test_blocks_are_learned_from_alike_whatever_the_tasks(blocks):
    made, slots = blocks
    t = scoring.Training()

    def mean(tasks):
        parts = [b for task in tasks for b in scoring._train(iter(task), SimpleNamespace(value=(slots, None)), t, 0)]
        return scoring._mean(pa.Table.from_batches(parts))["weights"][0].values.to_numpy()

    assert np.allclose(mean([made]), mean([[b] for b in made]), atol=1e-6) and np.allclose(mean([made]), mean([made[2:], made[:2]]), atol=1e-6)


def test_scores_equal_a_pass_over_single_ids(blocks):
    made, slots = blocks
    b = next(scoring.Block(r, slots) for r in scoring._each(iter(made)))
    _, weights = scoring.train_block(b, slots, None, scoring.Training(), 0)
    model = scoring.Attention(slots.counts, scoring.Training())
    model.load(weights)
    p = {k: w.astype(np.float64) for k, w in model.p.items()}
    d = p["o"].shape[0]
    got = scoring.score_block(b, slots, model)

    def log_softmax(x):
        return x - x.max() - math.log(np.exp(x - x.max()).sum())

    for text in range(12):
        seq = b.target[b.starts[text] : b.starts[text] + b.sizes[text]].tolist()
        before = [-1, -1, *seq]
        want, scored = 0.0, 0
        for begin in range(0, max(1, len(seq) - scoring.OVERLAP), scoring.STEP):
            stop = min(begin + scoring.WINDOW, len(seq))
            row = lambda slot: model.own + 1 if slot < 0 else min(slot, model.own)
            x = [p["now"][row(before[i + 1])] + p["last"][row(before[i])] + p["place"][i - begin] for i in range(begin, stop)]
            q, k, v = ([z @ p["qkv"][:, j * d : (j + 1) * d] for z in x] for j in range(3))
            for i in range(scored, stop):
                at = i - begin
                share = np.exp(log_softmax(np.array([q[at] @ k[j] / math.sqrt(d) for j in range(at + 1)])))
                y = x[at] + sum(s * v[j] for j, s in enumerate(share)) @ p["o"]
                h = y + np.maximum(y @ p["m1"], 0) @ p["m2"]
                first = log_softmax(p["first"] @ h + p["first_bias"])
                slot = seq[i]
                if slot < model.head:
                    want += first[slot]
                else:
                    c = (slot - model.head) // scoring.CLUSTER
                    part = slice(c * scoring.CLUSTER, min((c + 1) * scoring.CLUSTER, model.slots - model.head))
                    want += first[model.head + c] + log_softmax(p["inside"][part] @ h + p["inside_bias"][part])[slot - model.head - part.start]
                want += slots.share if slot == slots.rare else 0
            scored = stop
        assert scored == len(seq) and got[text] == pytest.approx(want, rel=1e-4)


def test_probabilities_sum_to_one(monkeypatch):
    monkeypatch.setattr(scoring, "TRAINED", 300)
    monkeypatch.setattr(scoring, "CLUSTER", 64)
    counts = np.array([9.0, 0, 4] * 200 + [7])
    slots = scoring.Slots(counts)
    model = scoring.Attention(slots.counts, scoring.Training(dim=6))
    assert model.own < model.slots
    h = np.random.default_rng(1).normal(0, 1, (1, 6)).astype(np.float32)
    logs = model._outcomes(np.repeat(h, model.slots, 0), np.arange(model.slots))[0]
    assert np.exp(logs).sum() == pytest.approx(1, rel=1e-5)
    assert (slots.counts[slots.of] == counts).all() and slots.rare == model.slots - 1


def test_gradients_of_the_attention_model():
    rng = np.random.default_rng(0)
    model = scoring.Attention(np.sort(rng.integers(1, 9, 300).astype(float))[::-1], scoring.Training(dim=6, seed=1))
    model.p = {k: w.astype(np.float64) for k, w in model.p.items()}
    now, last, target = (rng.integers(0, 300, (2, scoring.WINDOW)) for _ in range(3))
    counted = rng.random((2, scoring.WINDOW)) < 0.7
    counted[0, 0] = True
    target[0, 0] = 130
    grads = model.gradients(now, last, target, counted)
    spots = (("now", (now[0, 0], 2)), ("last", (last[1, 4], 1)), ("qkv", (1, 2)), ("qkv", (3, 9)), ("qkv", (0, 15)), ("o", (2, 1)), ("m1", (2, 3)), ("m2", (5, 4)), ("first", (0, 3)), ("first_bias", (3,)), ("inside", (2, 1)), ("inside_bias", (2,)), ("place", (3, 2)))
    for name, spot in spots:
        w = model.p[name]
        w[spot] += 1e-5
        up = -model.score(now, last, target, counted).sum()
        w[spot] -= 2e-5
        down = -model.score(now, last, target, counted).sum()
        w[spot] += 1e-5
        assert grads[name][spot] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6), name


def test_rows_without_gradients_take_no_part_in_training(monkeypatch, blocks):
    """A block's training holds the input rows of its training texts alone, and leaves all others as they were."""
    made, slots = blocks
    b = next(scoring.Block(r, slots) for r in scoring._each(iter(made)))
    t, sizes = scoring.Training(), []
    gradients = scoring.Attention.gradients

    def noting(self, *batch):
        sizes.append(len(self.p["now"]))
        return gradients(self, *batch)

    monkeypatch.setattr(scoring.Attention, "gradients", noting)
    _, weights = scoring.train_block(b, slots, None, t, 0)
    model = scoring.Attention(slots.counts, t)
    learned = np.repeat(~b.held, b.sizes)
    used = np.unique(model.inputs(np.concatenate([b.now[learned], b.last[learned]])))
    assert set(sizes) == {len(used)} and len(used) < model.own + 2
    start = {k: w.copy() for k, w in model.p.items()}
    model.load(weights)
    for name in ("now", "last"):
        moved = np.flatnonzero((model.p[name] != start[name]).any(1))
        assert len(moved) and np.isin(moved, used).all()


def test_steps_equal_plain_adam():
    rng = np.random.default_rng(2)
    model = scoring.Attention(np.sort(rng.integers(1, 9, 900).astype(float))[::-1], scoring.Training())
    adam, plain = scoring.Adam(model, 0.01), {k: w.astype(np.float64) for k, w in model.p.items()}
    m, v = ({k: np.zeros(w.shape) for k, w in plain.items()} for _ in range(2))
    assert model.p["now"].size > scoring.PIECE
    for step in range(1, 6):
        grads = {k: rng.normal(0, 1, w.shape).astype(np.float32) for k, w in model.p.items()}
        rate = 0.01 * min(1.0, step / 20) * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * (g / 7.0)
            v[k] = 0.99 * v[k] + 0.01 * (g / 7.0) ** 2
            plain[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-6)
        adam.apply(grads, 7)
    assert all(np.allclose(model.p[k], plain[k], atol=1e-5) for k in plain)


@pytest.mark.parametrize("words", [["one", "don't", "a1b22", "!!x", "été", "日本語", "ﬁn🙂", "'s", "-", "x" * 300], ["a\x1cb", " ", "x ", "y\x85z"], []])
def test_words_encoded_together_equal_words_encoded_alone(words):
    import public_tokenizers as p
    import tiktoken

    ranks = scoring.read_ranks(p.path("byte_bpe_multi_50k.tiktoken"))
    tokenizer = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    widths[list(ranks.values())] = [len(x) for x in ranks]
    for vocab in ([w.encode() for w in words], [*(w.encode() for w in words), b"\xff\xfe", b"z"]):
        ids, lengths = scoring._subwords(vocab, tokenizer, widths)
        want = [tokenizer.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in vocab]
        assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


@pytest.mark.parametrize("bits", [0, 1, 5])
def test_words_are_counted_by_parts_of_blocks(blocks, bits):
    """A row goes out for each part of a block, not for each word, and the counts come back in the order of the block's words."""
    made, _ = blocks
    rows = [pa.RecordBatch.from_arrays([pa.array([i]), m["keys"], m["trained"]], names=["block", "keys", "trained"]) for i, m in enumerate(made)]
    sent = pa.Table.from_batches(list(scoring._parts(iter(rows), bits)))
    assert len(sent) <= len(made) << bits
    want: dict[int, int] = {}
    for m in made:
        for k, c in zip(scoring._ints(m["keys"][0], np.uint64).tolist(), scoring._ints(m["trained"][0]).tolist(), strict=True):
            want[k] = want.get(k, 0) + c
    got = pa.concat_tables([scoring._count(sent.filter(pa.array([x == part for x in sent["part"].to_pylist()]))) for part in set(sent["part"].to_pylist())]).to_pylist()
    assert sum(r["n"] for r in got) == sum(want.values()) and sum(r["v"] for r in got) == sum(c > 0 for c in want.values())
    for i, m in enumerate(made):
        back = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted((r for r in got if r["block"] == i), key=lambda r: r["part"])])
        assert back.tolist() == [want[k] for k in scoring._ints(m["keys"][0], np.uint64).tolist()]


def test_large_logits_keep_their_probabilities():
    """Logits beyond 60 that differ have different probabilities, and gradients, too."""
    model = scoring.Attention(np.sort(np.random.default_rng(0).integers(1, 9, 300).astype(float))[::-1], scoring.Training(dim=6))
    h = np.random.default_rng(1).normal(0, 1, (20, 6)).astype(np.float32)
    target = np.arange(20) * 13
    for factor in (1, 300, 3000):
        big = (h * np.float32(factor)).astype(np.float32)
        got, _, grads = model._outcomes(big, target, learn=True)
        p = {k: w.astype(np.float64) for k, w in model.p.items()}
        first = big.astype(np.float64) @ p["first"].T + p["first_bias"]
        share = np.exp(first - first.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
        cluster = np.maximum(target - model.head, -1) // scoring.CLUSTER
        outcome = np.where(cluster < 0, target, model.head + cluster)
        head = cluster < 0
        assert factor == 1 or first.max() > 60
        want = first - first.max(1, keepdims=True)
        want = want[np.arange(20), outcome] - np.log(np.exp(want).sum(1))
        assert got[head] == pytest.approx(want[head], rel=1e-3, abs=1e-3)
        moved = share.copy()
        moved[np.arange(20), outcome] -= 1
        assert grads["first_bias"] == pytest.approx(moved.sum(0), abs=1e-3)


def test_frozen_weights_score_alike(blocks):
    made, slots = blocks
    b = next(scoring.Block(r, slots) for r in scoring._each(iter(made)))
    model = scoring.Attention(slots.counts, scoring.Training())
    want = scoring.score_block(b, slots, model)
    model.freeze()
    assert np.array_equal(scoring.score_block(b, slots, model), want)


def test_large_attention_scores_keep_their_shares():
    rng = np.random.default_rng(3)
    model = scoring.Attention(np.sort(rng.integers(1, 9, 300).astype(float))[::-1], scoring.Training(dim=6))
    now, last = (rng.integers(0, 300, (3, scoring.WINDOW)) for _ in range(2))
    for factor in (1, 30, 300):
        model.p["qkv"][:, :12] = scoring.Attention(np.ones(300), scoring.Training(dim=6)).p["qkv"][:, :12] * factor
        p = {k: w.astype(np.float64) for k, w in model.p.items()}
        with np.errstate(over="ignore", invalid="ignore"):
            h = model._forward(now, last)[-1].reshape(3, scoring.WINDOW, 6)
        x = p["now"][now] + p["last"][last] + p["place"]
        q, k, v = np.split(x @ p["qkv"], 3, 2)
        s = np.where(np.tri(scoring.WINDOW, dtype=bool), q @ k.transpose(0, 2, 1) / 6**0.5, -np.inf)
        assert factor == 1 or s.max() > 60
        s = np.exp(s - s.max(2, keepdims=True))
        y = x + (s / s.sum(2, keepdims=True)) @ v @ p["o"]
        assert h == pytest.approx(y + np.maximum(y @ p["m1"], 0) @ p["m2"], abs=2e-2)


def test_passes_need_their_columns_alone(blocks):
    """Subword ids are counted without the texts' words, and texts are trained on and scored without the counts of training."""
    made, slots = blocks
    counts = np.zeros(len(slots.of))
    for part in scoring._piece_counts(iter(b.select(["held", "trained", "pieces", "piece_sizes"]) for b in made)):
        np.add.at(counts, part["piece"].to_numpy(), part["n"].to_numpy())
    assert np.array_equal(np.sort(counts[counts > 0]), np.sort(slots.counts[slots.counts > 0]))
    whole, less = (next(scoring._each(iter([b]))) for b in (made[0], made[0].drop_columns(["keys", "trained"])))
    assert np.array_equal(scoring.Block(whole, slots).target, scoring.Block(less, slots).target)
