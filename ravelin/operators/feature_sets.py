"""Sets of columns that a model may see, generated from blocks that the caller declares.

A block is a name and a test of a column's name. The product of two columns is
named with both, joined by a mark, and belongs to the blocks of each factor.
From the blocks follow the sets of an ablation by rule: everything, every block
alone, everything without it, and unions that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

Blocks = Mapping[str, Callable[[str], bool]]


def starting(**prefixes: str | tuple[str, ...]) -> dict[str, Callable[[str], bool]]:
    """Blocks told by how a column's name begins."""
    return {name: (lambda c, p=prefix: c.startswith(p)) for name, prefix in prefixes.items()}


def blocks_of(column: str, blocks: Blocks, cross: str | None = None) -> frozenset[str]:
    """The blocks of a column, of each factor if it is a product; empty if none claims it."""
    factors = column.split(cross) if cross else [column]
    return frozenset(name for name, test in blocks.items() if any(test(f) for f in factors))


def generate(columns: Sequence[str], blocks: Blocks, unions: Iterable[Sequence[str]] = (), cross: str | None = None) -> dict[str, list[str]]:
    """Set to its columns, in the order of `columns`: `all`, `only b`, `without b`, and `a+b` for each union.

    `only` and unions hold columns all of whose blocks are among those named,
    so a product is in only if both factors are; `without` drops every column
    that has the block. Columns that no block claims are in `all` and `without`.
    A block that nothing belongs to gives no set, nor does a set without a
    column; an unknown block in a union is an error.
    """
    owned = {c: blocks_of(c, blocks, cross) for c in columns}
    used = [b for b in blocks if any(b in o for o in owned.values())]
    rules: dict[str, Callable[[frozenset[str]], bool]] = {"all": lambda o: True}
    for b in used:
        rules[f"only {b}"] = lambda o, b=b: o == {b}
        rules[f"without {b}"] = lambda o, b=b: b not in o
    for union in unions:
        if missing := set(union) - set(blocks):
            raise ValueError(f"no blocks {', '.join(sorted(missing))}")
        rules["+".join(union)] = lambda o, u=frozenset(union): bool(o) and o <= u
    sets = {name: [c for c in columns if rule(owned[c])] for name, rule in rules.items()}
    return {name: cs for name, cs in sets.items() if cs}
