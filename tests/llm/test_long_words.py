"""The quality scorer reads words of any length to their end."""

import random

from korpusflow.llm import quality_model


def test_scorer_reads_the_whole_of_a_long_word():
    r = random.Random(3)
    clean = "本" * 4000
    junk = "".join(r.choice("aA0#$%&*|<>本") for _ in range(4000))
    known = lambda t: dict(zip((p := quality_model.profile(t)).places, p.values, strict=True))
    assert known(clean + junk) != known(clean)
    assert known(clean + junk) != known(clean + junk[::-1])
    assert quality_model.shapes("Don't!!") == ["Aa'a!"]
    assert "".join(quality_model.shapes("a1" * 300)) == "a0" * 300
