"""Checks of a program and the order in which its predicates are evaluated."""

from __future__ import annotations

from .language import Atom, Compare, Is, ProgramError, Rule, Var, variables

TESTS = {"@contains": 2, "@starts_with": 2, "@ends_with": 2, "@regex_match": 2}


def check_rule(rule: Rule, builtins: dict[str, int], outputs: dict[str, int]) -> None:
    """Raise ProgramError unless every variable is bound where it is needed.

    Atoms, `is` and binding builtins bind; inputs of the latter two must be bound lexically earlier.
    builtins: arity by name (-1: any); outputs: how many last arguments a builtin binds.
    """
    bound: set[str] = set()
    for b in rule.body:
        if isinstance(b, Atom) and b.name[0] == "@":
            if b.name not in builtins:
                raise ProgramError(f"unknown builtin {b.name} in {rule}")
            if builtins[b.name] not in (-1, len(b.terms)):
                raise ProgramError(f"{b.name} takes {builtins[b.name]} arguments: {rule}")
            if b.negated:
                raise ProgramError(f"builtins cannot be negated: {rule}")
    plain = [b for b in rule.body if isinstance(b, Atom) and b.name[0] != "@" and not b.negated]
    everywhere = set().union(*(variables(b) for b in plain)) if plain else set()
    for b in rule.body:
        if isinstance(b, Atom) and not b.negated and b.name[0] != "@":
            bound |= variables(b)
        elif isinstance(b, Is):
            if missing := variables(b.expr) - bound:
                raise ProgramError(f"{sorted(missing)} not bound before {b} in {rule}")
            bound |= variables(b.var)
        elif isinstance(b, Atom) and b.name in outputs:
            n = len(b.terms) - outputs[b.name]
            if missing := variables(b.terms[:n]) - bound - everywhere:
                raise ProgramError(f"{sorted(missing)} not bound before {b} in {rule}")
            bound |= variables(b.terms[n:])
    for b in rule.body:
        need = set()
        if isinstance(b, Compare) or isinstance(b, Atom) and b.name in TESTS:
            need = variables(b)
        elif isinstance(b, Atom) and b.negated:
            need = {v for v in variables(b) if v[0] != "?"}
        if missing := need - bound:
            raise ProgramError(f"{sorted(missing)} not bound in {b} of {rule}")
    produced = bound | ({rule.aggregate.result.name} if rule.aggregate else set())
    if missing := variables(rule.head) - produced:
        raise ProgramError(f"head variables {sorted(missing)} are not bound in {rule}")
    if rule.aggregate:
        if rule.aggregate.result.name not in variables(rule.head):
            raise ProgramError(f"the aggregate's result is not in the head of {rule}")
        if isinstance(rule.aggregate.term, Var) and rule.aggregate.term.name not in bound:
            raise ProgramError(f"the aggregate's term is not bound in {rule}")


def strata(rules: list[Rule]) -> list[list[str]]:
    """Groups of predicate names in evaluation order, recursive ones together.

    Negation and aggregation must not lead back into their own group: ProgramError.
    """
    heads = list(dict.fromkeys(r.head.name for r in rules))
    uses: dict[str, dict[str, bool]] = {h: {} for h in heads}
    for r in rules:
        for b in r.body:
            if isinstance(b, Atom) and b.name in uses:
                uses[r.head.name][b.name] = uses[r.head.name].get(b.name, False) or b.negated or r.aggregate is not None
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    order: list[list[str]] = []

    def visit(start: str) -> None:
        work = [(start, iter(uses[start]))]
        number[start] = low[start] = len(number)
        stack.append(start)
        while work:
            name, rest = work[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    stack.append(other)
                    work.append((other, iter(uses[other])))
                    break
                if other in stack:
                    low[name] = min(low[name], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[name])
                if low[name] == number[name]:
                    group = []
                    while not group or group[-1] != name:
                        group.append(stack.pop())
                    order.append(group)

    for h in heads:
        if h not in number:
            visit(h)
    for group in order:
        for a in group:
            for b, strict in uses[a].items():
                if strict and b in group:
                    raise ProgramError(f"{a} depends on {b} through negation or aggregation and back")
    return order


def needed(rules: list[Rule], goals: set[str]) -> list[Rule]:
    """The rules that goals depend on."""
    reach, grown = set(goals), True
    while grown:
        found = {b.name for r in rules if r.head.name in reach for b in r.body if isinstance(b, Atom)}
        grown = not found <= reach
        reach |= found
    return [r for r in rules if r.head.name in reach]
