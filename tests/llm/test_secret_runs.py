"""Values after credentials' names: against a plain scan, and in linear time."""

import random
import time

import pytest

from noteloom.llm import secrets as s


def plain(text):
    """Each place of a name in turn; a value within one that was judged is not judged again."""
    spans, judged, at = [], 0, 0
    while at < len(text):
        m = s.CONTEXT.match(text, at)
        if m and m.start(1) >= judged:
            value = m[1].rstrip('",;)]}')
            judged = m.end()
            if len(value) >= 6 and s.guess_cost(value)[0] >= s.GUESS_LIMIT:
                spans.append((m.start(1), m.start(1) + len(value), 3))
                at = judged
                continue
        at += 1
    return spans


PARTS = ["pwd", "pass", "login", "Token", "secret", "api_key", "authorization", ":", "=", ": ", " = ", " ", "Bearer ", "dragon", "2020-01-01", "xK9#q", "Zz7!pQ4w", "hunter2", "aaaa", "qwerty", "\n", '"', ",", "ß", "dbpassword", "Reisepass"]


@pytest.mark.parametrize("seed", range(40))
def test_against_a_plain_scan(seed):
    r = random.Random(seed)
    for _ in range(60):
        text = "".join(r.choice(PARTS) for _ in range(r.randrange(1, 25)))
        assert [x for x in s.scan(text) if x[2] == 3] == plain(text), text


@pytest.mark.parametrize("unit", ["pwd:", "pass:", "login=", "token:secret=", "pwd: ", "apikey", "password ", "a1:pass:"])
def test_linear(unit):
    began = time.time()
    s.scan(unit * (100_000 // len(unit)))
    assert time.time() - began < 3


def test_name_at_the_end_of_a_cheap_value():
    text = "login: password: Xk93#vQz81 end"
    assert [text[a:b] for a, b, k in s.scan(text) if k == 3] == ["Xk93#vQz81"]
