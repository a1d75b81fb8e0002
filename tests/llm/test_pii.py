import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import pii

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute(text):
    spans = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = [True, all(int(p) <= 255 for p in m[0].split(".")) if k == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15][k]
            if ok:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("ab@.-+ 0123459()_é\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == brute(text), text
    for text in ("4111 1111 1111 1111", "a@b.cd_x@y.zz+q@r.s", "+1 (974) 555-3436 x", "1.2.3.4.5.6.7.8", "00000000000000000001.2.3.4", "9" * 5000):
        assert pii.base_spans(text) == brute(text)


def test_long_texts_are_linear():
    for text in ("a" * 2_000_000, "1" * 2_000_000, "a@" * 300_000, "+1 " * 300_000, "1." * 300_000, "x1 " * 200_000):
        pii.base_spans(text)
        list(pii.chains(text))


@pytest.fixture(scope="module")
def field():
    rng = random.Random(6)
    rows = []
    for _ in range(150):
        word = lambda: "".join(rng.choice("etaoin") for _ in range(rng.randint(2, 7)))
        text = f"{word()} {word()} " + rng.choice([f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)),
                                                     "+1 (%03d) 555-%04d" % (rng.randint(0, 999), rng.randint(0, 9999)), card(rng), f"{rng.randint(1, 99999)}"]) + f" {word()} {word()}"
        rows += pii.labelled_windows(text)
    return pii.train_field(rows + pii.variant_rows([r[0] for r in rows]) + pii.pair_rows(rows))


def card(rng):
    head = "".join(str(rng.randint(0, 9)) for _ in range(15))
    return next(head + str(i) for i in range(10) if pii.luhn(head + str(i)))


def test_field_learns_the_labels(field):
    rng, right, n = random.Random(7), 0, 0
    for _ in range(200):
        kind, text = rng.choice([(2, card(rng)), (1, ".".join(str(rng.randint(0, 255)) for _ in range(4))), (3, "+1 (%03d) 555-%04d" % (rng.randint(0, 999), rng.randint(0, 9999)))])
        got = pii._decoded(field, [f"some words {text} and more"])[0]
        n, right = n + 1, right + (got == [(11, kind, 11 + len(text))])
    assert right > 0.9 * n
    both = "see 4111111111111111 5500005555555559 here"
    assert pii.base_spans(both) == []
    assert [x[1] for x in pii.find_spans([both], field)[0][1]] == [2, 2]
    assert pii.find_spans(["call (317) 010-4477 now"], field)[0][1] == [(5, 3, 19)]
    for clean in ("made in 1999 by 12 people", "on 2021-03-04 at 10:30", "4111111111111112 is wrong", "no numbers", ""):
        assert pii.find_spans([clean], field)[0][1] == []


def test_viterbi_matches_brute_force():
    rng = np.random.default_rng(1)
    field = pii.Field({}, {})
    s = len(pii.STATES)
    field.w["move"] = rng.normal(size=(s, s))
    e, sizes = rng.normal(size=(20, 4, s)), np.array([1, 2, 3, 4] * 5)
    got = field.viterbi(e, sizes)
    grid = np.stack(np.meshgrid(*[np.arange(s)] * 4, indexing="ij"), -1).reshape(-1, 4)
    for i, n in enumerate(sizes):
        paths = grid[(grid[:, n:] == 0).all(1)][:, :n]
        score = e[i, 0, paths[:, 0]] + field.w["move"][0, paths[:, 0]] + field.w["move"][paths[:, -1], 0]
        for t in range(1, n):
            score = score + e[i, t, paths[:, t]] + field.w["move"][paths[:, t - 1], paths[:, t]]
        assert got[i, :n].tolist() == paths[score.argmax()].tolist()


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(2)
    field = pii.Field({"a": 1, "b": 2}, {"a": 1})
    for w in field.w.values():
        w += rng.normal(size=w.shape)
    x = np.stack([rng.integers(0, n, (6, 3)) for n in (3, 2, 2, 2, 3)], -1)
    y = rng.integers(0, len(pii.STATES), (6, 3))
    live = np.arange(3)[None] < np.array([1, 2, 3, 3, 2, 1])[:, None]
    s = len(pii.STATES)

    def loss():
        total, move = 0.0, field.w["move"]
        for i in range(6):
            n = int(live[i].sum())
            e = field.emissions(x[i])
            paths = np.stack(np.meshgrid(*[np.arange(s)] * n, indexing="ij"), -1).reshape(-1, n)
            score = move[0, paths[:, 0]] + move[paths[:, -1], 0] + sum(e[t, paths[:, t]] for t in range(n)) + sum(move[paths[:, t - 1], paths[:, t]] for t in range(1, n))
            own = move[0, y[i, 0]] + move[y[i, n - 1], 0] + sum(e[t, y[i, t]] for t in range(n)) + sum(move[y[i, t - 1], y[i, t]] for t in range(1, n))
            total += np.log(np.exp(score).sum()) - own
        return total

    grads = pii._gradients(field, x, y, live)
    for name, at in (("fine", (2, 3)), ("here", (1, 0)), ("before", (1, 5)), ("kind", (0, 2)), ("move", (0, 4)), ("move", (3, 0)), ("move", (2, 2))):
        field.w[name][at] += 1e-5
        up = loss()
        field.w[name][at] -= 2e-5
        down = loss()
        field.w[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-4, name


def test_query_shape_and_redaction(spark, docs, hard_docs, no_docs):
    rows = [(1, "mail a.b@c.de or 1.2.3.4, 4111 1111 1111 1111"), (2, None), (3, ""), (None, "+49 (30) 123-4567-8"), (1, "mail a.b@c.de or 1.2.3.4, 4111 1111 1111 1111")]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, spans string, n_email int")
    field = pii.train_on(frame)
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.find_personal_data(frame, field).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 1, 1, 1, 0, sha("email:5:13,ip:17:24,card:26:45")), (2, 0, 0, 0, 0, sha("")), (3, 0, 0, 0, 0, sha("")), (None, 0, 0, 0, 1, sha("phone:0:19"))}
    clean = {r.doc_id: r.text for r in pii.redact(frame, field).collect()}
    assert clean == {1: "mail [EMAIL] or [IP], [CARD]", 2: None, 3: "", None: "[PHONE]"}
    n = {r.doc_id: r for r in pii.find_personal_data(docs, pii.train_on(docs)).collect()}
    assert len(n) == len({d for d, _ in hard_docs})
    assert pii.find_personal_data(no_docs, pii.train_on(no_docs)).collect() == []


def test_any_text_is_decoded(field):
    rng = random.Random(9)
    odd = ["1..2.3.4", ".1.2.3.4", "1.2..3.4.", "::1.2.3.4::", "1.2.3.4....", "9" * 300 + ".1.1.1", "@", "@1", "1@", "+", "1...2...3...4", "٣.١.٢.٤", "1.2.3.４"]
    texts = odd + [" ".join(odd)] + ["".join(rng.choice("ab@.-+ 0123456789().,_é\n") for _ in range(rng.randint(0, 80))) for _ in range(1500)]
    for text, (base, spans) in zip(texts, pii.find_spans(texts, field)):
        assert base == pii.base_spans(text) and set(base) <= set(spans)
        assert all(0 <= s < e <= len(text) for s, _, e in spans)
