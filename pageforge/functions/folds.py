"""Running values over an array, as SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a part. A fold copies all that it carries at every step, so what a step carries must stay small: the state
#: alone over the whole array, and the values of one part only.
PART = 256


def scan(items: str, state: dict[str, tuple[str, str, str]], value: str, kind: str, item: str = "w") -> str:
    """An array with a value of type `kind` for each item, worked out from the item and the state `a` that the items
    before it left. state: for each name its type, its start, and what it is after an item.

    Two passes, each linear in the items (of up to PART items, one): one carries the state from part to part and keeps it at the start of each, the
    other works out the values of each part from there.
    """
    types = f"struct<{','.join(f'{name}:{t}' for name, (t, _, _) in state.items())}>"
    start = "CAST(named_struct(" + ", ".join(f"'{name}', {first}" for name, (_, first, _) in state.items()) + f") AS {types})"
    after = ", ".join(f"'{name}', {then}" for name, (_, _, then) in state.items())
    part = f"slice({items}, CAST(c AS INT) * {PART} + 1, {PART})"
    parts = f"IF(size({items}) > 0, sequence(0, CAST((size({items}) - 1) div {PART} AS INT)), array())"
    # no part starts after the last one, so what it leaves isn't worked out: most arrays are a single part
    left = f"IF(c < CAST((size({items}) - 1) div {PART} AS INT), aggregate({part}, b.s, (a, {item}) -> named_struct({after})), b.s)"
    starts = (
        f"aggregate({parts}, CAST(named_struct('s', {start}, 'o', array()) AS struct<s:{types},o:array<{types}>>), "
        f"(b, c) -> named_struct('s', {left}, 'o', array_append(b.o, b.s)), b -> b.o)"
    )
    carried = ", ".join(f"'{name}', s.{name}" for name in state)
    return (
        f"flatten(transform({starts}, (s, c) -> aggregate({part}, CAST(named_struct({carried}, 'part', array()) "
        f"AS struct<{types[7:-1]},part:array<{kind}>>), (a, {item}) -> named_struct({after}, 'part', array_append(a.part, {value})), a -> a.part)))"
    )


def runs(items: str, keys: str, body: str) -> str:
    """An array with `body`, SQL on the array `r`, for each run of items whose keys (an array beside items) are equal. Linear
    in the items."""
    starts = f"filter(sequence(0, size({items}) - 1), i -> i = 0 OR {keys}[i] <> {keys}[i - 1])"
    cut = f"transform(s, (a, n) -> slice({items}, a + 1, coalesce(get(s, n + 1), size({items})) - a))"
    return f"IF(size({items}) > 0, flatten(transform(array({starts}), s -> transform({cut}, r -> {body}))), array())"


def items(array: str) -> Column:
    """All items of an array column, for explode: of a column as such, Spark asks first whether it has items, in a filter that
    moves below the steps that make the column and works them out again."""
    return F.expr(f"slice({array}, 1, size({array}))")


def before(size: str, value: str, join: str, start: str = "0", kind: str = "int") -> str:
    """An array with, for each w from 1 to `size`, what `start` and the values before w come to under `join`, an
    associative operation on {a} and {x}. Values are joined by parts and parts by their own totals, as a fold copies all
    that it carries at every step."""
    part = f"sequence(c * {PART} + 1, least(c * {PART} + {PART}, {size}))"
    joined = lambda a, x: "(" + join.format(a=a, x=f"({x})") + ")"
    pair = f"struct<p:{kind},o:array<{kind}>>"
    total = f"transform(sequence(0, CAST(({size} - 1) div {PART} AS int)), c -> aggregate({part}, CAST({start} AS {kind}), (s, w) -> {joined('s', value)}))"
    first = (
        f"aggregate({total}, CAST(named_struct('p', {start}, 'o', array()) AS {pair}), "
        f"(a, x) -> named_struct('p', {joined('a.p', 'x')}, 'o', array_append(a.o, a.p)), a -> a.o)"
    )
    return (
        f"flatten(transform({first}, (f, c) -> aggregate({part}, CAST(named_struct('p', f, 'o', array()) AS {pair}), "
        f"(a, w) -> named_struct('p', {joined('a.p', value)}, 'o', array_append(a.o, a.p)), a -> a.o)))"
    )
