"""Secret scans by one deterministic automaton over all rules.

Rules are regular expressions of a small dialect (classes, groups, alternatives, ?, *, +, {m}, {m,}) over bytes. All rules
together, each free to start anywhere, become one automaton by subset construction, minimised by partition refinement into
transition arrays. Each text is read once, byte by byte; where a rule stops accepting, a match of it ends there, and the
reversed automaton of that rule alone is read backwards from the end to the leftmost start that isn't used yet. So matches
are leftmost, longest and do not overlap within a rule, as each rule's own regular expression would find them.

Base rules: assign, access, hex. Further rules add spans and never take from the base ones: pem (heads of private keys)
and github (tokens by prefix). Spans count code points of the text, end exclusive.

A null or empty text has no spans. Rows with equal doc_id are scanned each.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberframe.llm.common import by_batch, ident, texts

#: kind, rule.
RULES = (
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]{16,}"),
    ("pem", r"-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    ("github", r"gh[pousr]_[A-Za-z0-9]+"),
)
BASE = ("assign", "access", "hex")
#: Characters of a match at least. Counting them here keeps the automaton small where a rule's start can recur inside it.
LEAST = {"access": 18, "github": 40}
LEAST_VALUE = 12
_VALUE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")


def parse(rule: str):
    """Syntax tree: ('set', bytes), ('cat', trees), ('alt', trees), ('rep', tree, least, most or None)."""
    at = 0

    def alternatives():
        nonlocal at
        out = [sequence()]
        while at < len(rule) and rule[at] == "|":
            at += 1
            out.append(sequence())
        return ("alt", out) if len(out) > 1 else out[0]

    def sequence():
        out = []
        while at < len(rule) and rule[at] not in "|)":
            out.append(repeated(atom()))
        return ("cat", out)

    def atom():
        nonlocal at
        c = rule[at]
        at += 1
        if c == "(":
            tree = alternatives()
            at += 1
            return tree
        if c == "\\":
            at += 1
            return ("set", frozenset([ord(rule[at - 1])]))
        if c != "[":
            return ("set", frozenset([ord(c)]))
        members = set()
        while rule[at] != "]":
            if rule[at + 1] == "-" and rule[at + 2] != "]":
                members.update(range(ord(rule[at]), ord(rule[at + 2]) + 1))
                at += 3
            else:
                members.add(ord(rule[at]))
                at += 1
        at += 1
        return ("set", frozenset(members))

    def repeated(tree):
        nonlocal at
        if at < len(rule) and rule[at] in "?*+{":
            c = rule[at]
            at += 1
            if c != "{":
                return ("rep", tree, int(c == "+"), 1 if c == "?" else None)
            end = rule.index("}", at)
            least, comma, most = rule[at:end].partition(",")
            at = end + 1
            return ("rep", tree, int(least), (int(most) if most else None) if comma else int(least))
        return tree

    return alternatives()


def reverse(tree):
    if tree[0] == "cat":
        return ("cat", [reverse(x) for x in reversed(tree[1])])
    if tree[0] == "alt":
        return ("alt", [reverse(x) for x in tree[1]])
    return ("rep", reverse(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class _Nfa:
    def __init__(self):
        self.free, self.by = [], []

    def state(self) -> int:
        self.free.append([])
        self.by.append([])
        return len(self.free) - 1

    def add(self, tree, start: int) -> int:
        """The end of a path for tree from start."""
        if tree[0] == "set":
            end = self.state()
            self.by[start].append((tree[1], end))
            return end
        if tree[0] == "cat":
            for x in tree[1]:
                start = self.add(x, start)
            return start
        end = self.state()
        if tree[0] == "alt":
            for x in tree[1]:
                self.free[self.add(x, start)].append(end)
            return end
        _, x, least, most = tree
        for _ in range(least):
            start = self.add(x, start)
        if most is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(x, loop)].append(loop)
            self.free[loop].append(end)
            return end
        for _ in range(most - least):
            self.free[start].append(end)
            start = self.add(x, start)
        self.free[start].append(end)
        return end


def compile_rules(trees: list, anywhere: bool) -> tuple[list[list[int]], list[int]]:
    """Transition arrays of the minimal automaton, and for each state the bits of the rules that it accepts. State 0 starts;
    without `anywhere`, the dead state is -1."""
    nfa = _Nfa()
    start = nfa.state()
    accepts = {nfa.add(t, start): 1 << i for i, t in enumerate(trees)}

    def closure(states):
        stack, seen = list(states), set(states)
        while stack:
            for x in nfa.free[stack.pop()]:
                if x not in seen:
                    seen.add(x)
                    stack.append(x)
        return frozenset(seen)

    alike: dict = {}  # bytes that no set tells apart
    sets = list({m for by in nfa.by for m, _ in by})
    for b in range(256):
        alike.setdefault(tuple(b in m for m in sets), []).append(b)
    alike = list(alike.values())
    class_of = {b: i for i, members in enumerate(alike) for b in members}
    for by in nfa.by:
        by[:] = [(sorted({class_of[b] for b in members}), end) for members, end in by]

    first = closure({start})
    number, order, moves = {first: 0}, [first], []
    for states in order:
        to = [set(first) if anywhere else set() for _ in alike]
        for s in states:
            for members, end in nfa.by[s]:
                for b in members:
                    to[b].add(end)
        row, known = [], {}
        for target in to:
            key = frozenset(target)
            if key not in known:
                known[key] = closure(key)
                if known[key] not in number:
                    number[known[key]] = len(order)
                    order.append(known[key])
            row.append(number[known[key]])
        moves.append(row)
    bits = [sum({accepts[s] for s in states if s in accepts}) for states in order]
    block = bits  # partition refinement from what is accepted
    while True:
        keys: dict = {}
        finer = [keys.setdefault((block[i], tuple(block[x] for x in moves[i])), len(keys)) for i in range(len(moves))]
        if len(set(finer)) == len(set(block)):
            break
        block = finer
    block = finer
    member = {b: i for i, b in reversed(list(enumerate(block)))}
    table = [[block[moves[member[b]][class_of[x]]] for x in range(256)] for b in range(len(member))]
    accept = [bits[member[b]] for b in range(len(member))]
    if not anywhere:
        dead = {b for b, row in enumerate(table) if not accept[b] and set(row) == {b}}
        table = [[-1 if x in dead else x for x in row] for row in table]
    return table, accept


@lru_cache(4)
def automata(rules: tuple = RULES):
    trees = [parse(r) for _, r in rules]
    forward, accept = compile_rules(trees, True)
    return forward, accept, [compile_rules([reverse(t)], False) for t in trees]


def _scan(data: bytes, rules: tuple) -> list[tuple[int, int, int]]:
    """(start, end, rule) in bytes."""
    backward = automata(rules)[2]
    out, row, live, used = [], _linked(rules), 0, [0] * len(rules)
    for at, b in enumerate(data):
        row = row[b]
        if row[256] != live:
            ended, live = live & ~row[256], row[256]
            if ended:
                _close(data, at, ended, backward, used, out)
    if live:
        _close(data, len(data), live, backward, used, out)
    return out


@lru_cache(4)
def _linked(rules: tuple) -> list:
    """The transition arrays, each entry the next state's array itself; entry 256 has the accepted rules."""
    table, accept, _ = automata(rules)
    rows: list[list] = [[None] * 257 for _ in table]
    for row, to, bits in zip(rows, table, accept, strict=True):
        row[:256] = [rows[x] for x in to]
        row[256] = bits
    return rows[0]


def _close(data: bytes, end: int, ended: int, backward, used: list[int], out: list) -> None:
    for rule in range(ended.bit_length()):
        if ended >> rule & 1:
            table, accept = backward[rule]
            state, at, start = 0, end, -1
            while at > used[rule]:
                at -= 1
                state = table[state][data[at]]
                if state < 0:
                    break
                if accept[state]:
                    start = at
            if start >= 0:
                used[rule] = end
                out.append((start, end, rule))


def _value(data: bytes, start: int, end: int) -> int:
    """Length of an assignment's value: what follows its first : or = behind the name, without spaces and a quote."""
    at = min(i for i in (data.find(b"=", start, end), data.find(b":", start, end)) if i >= 0) + 1
    while data[at] == 0x20:
        at += 1
    return end - at - (data[at] not in _VALUE)


def spans_of(text: str, rules: tuple = RULES) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then in the order of the rules."""
    data = text.encode("utf-8", "replace")
    found = sorted((s, r, e) for s, e, r in _scan(data, rules) if (_value(data, s, e) >= LEAST_VALUE if rules[r][0] == "assign" else e - s >= LEAST.get(rules[r][0], 0)))
    if found and len(data) != len(text):
        shift, at, out = 0, 0, []  # what the bytes before `at` have over their code points
        for s, r, e in found:
            own = data[at:s]
            shift += len(own) - len(own.decode("utf-8", "replace"))
            at = s
            out.append((s - shift, e - shift, rules[r][0]))  # what a rule matches is ASCII
        return out
    return [(s, e, rules[r][0]) for s, r, e in found]


def scan(docs: DataFrame, rules: tuple = RULES) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, secret)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches):
        for batch in batches:
            out = [[{"kind": k, "start": s, "end": e, "secret": t[s:e]} for s, e, k in spans_of(t, rules)] for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    return by_batch(ident(docs, "doc_id", "text"), run, f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long,secret:string>>")


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of op3."""

    def shown(c):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(k):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return scan(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown("spans").alias("spans")
    )


__all__ = ["automata", "report", "scan", "spans_of"]
