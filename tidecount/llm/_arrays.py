"""Running folds over arrays, as SQL of built-in functions."""

from __future__ import annotations

CHUNK = 256  # elements that a fold gathers at a time, as each appended one copies what it has gathered

SUM, MOST, LEAST = "{} + {}".format, "greatest({}, {})".format, "least({}, {})".format


def running(values: str, step=SUM, zero: str = "0L") -> str:
    """SQL for an array: for each element of an array of longs, the fold of those before it, by an associative ``step``. Linear in the array but for 2^-17 of its square."""

    def kept(array: str, start: str) -> str:
        return f"aggregate({array}, struct({start} AS at, cast(array() AS array<bigint>) AS out), (s_, v_) -> struct({step('s_.at', 'v_')} AS at, concat(s_.out, array(s_.at)) AS out), s_ -> s_.out)"

    parts = f"transform(sequence(0, cast(size(w_) div {CHUNK} AS int)), i_ -> slice(w_, i_ * {CHUNK} + 1, {CHUNK}))"
    heads = kept(f"transform(q_, p_ -> aggregate(p_, {zero}, (a_, v_) -> {step('a_', 'v_')}))", zero)
    # transform(array(x), y -> ...)[0] names a value
    return f"transform(array({values}), w_ -> transform(array({parts}), q_ -> flatten(zip_with(q_, {heads}, (p_, h_) -> {kept('p_', 'h_')})))[0])[0]"
