"""Secret scans with a trigram inverted index; DataFrame functions only.

Each rule's regular expression is taken apart into a Boolean query over trigrams that any match must contain. The index
has the postings (trigram, doc_id) of the trigrams that some query names, over lower-cased texts. Postings are
intersected and joined per rule, and only the candidates are matched against that rule's expression. A rule without a
mandatory trigram, such as a run of hexadecimal digits, scans every text.

Positions: a rule's matches and the pieces between them have the text's whole length, so a match begins where the
lengths of the pieces and matches before it end. These are summed in blocks, blocks of blocks and so on, so a sum up to
any match adds few parts: for a million matches, 64 at most on each of two levels and 244 on top.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import materialise

#: Strings that a part of an expression may stand for, at most, for its trigrams to be derived.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length; shorter matches are dropped after matching.
    group: int = 0
    least: int = 0
    base: bool = False


RULES = (
    # Fixed values of the base scan.
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    # What the method adds: formats that services publish.
    Rule("pem", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

Query = frozenset  # of alternatives, each a frozenset of trigrams that are all needed; the empty one is always met
ALWAYS: Query = frozenset([frozenset()])


def _both(a: Query, b: Query) -> Query:
    return _least(frozenset(x | y for x in a for y in b))


def _least(q: Query) -> Query:
    """Without alternatives that another one follows from."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _strings(node) -> set[str] | None:
    """The lower-cased strings that one part of an expression stands for; None: too many."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 2:
        one = _sequence_strings(arg[2])
        return None if one is None else {"".join(x) for k in range(arg[0], arg[1] + 1) for x in product(one, repeat=k)}
    if op is sre.AT:
        return {""}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        s = _strings(n)
        if s is None or len(out) * len(s) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str) -> Query:
    """What trigrams a lower-cased text that the pattern matches has: any of the alternatives, all of its trigrams."""

    def sequence(nodes) -> Query:
        found, run = ALWAYS, {""}
        for n in nodes:
            s = _strings(n)
            if s is not None and len(run) * len(s) <= MAX_STRINGS:
                run = {a + b for a in run for b in s}
                continue
            found, run = _both(found, _of_strings(run)), {""}
            if s is not None:
                run = s
                continue
            op, arg = n
            if op is sre.SUBPATTERN:
                found = _both(found, sequence(arg[3]))
            elif op is sre.BRANCH:
                found = _both(found, _least(frozenset().union(*(sequence(x) for x in arg[1]))))
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                found = _both(found, sequence(arg[2]))
        return _both(found, _of_strings(run))

    return sequence(sre_parse.parse(pattern))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """docs(doc_id, text) -> trigram (its place in trigrams), doc_id: the inverted index of these trigrams."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(i)) for i, t in enumerate(trigrams)]))
    return low.select(F.explode(held).alias("trigram"), "doc_id")


def candidates(index: DataFrame, queries: list[Query], trigrams: list[str]) -> DataFrame:
    """index(trigram, doc_id) -> doc_id, rules: a bit for each query that the document's postings meet. The bits of each
    document's postings come together in as many longs as the trigrams need; up to 63 queries."""
    at = {t: divmod(i, 63) for i, t in enumerate(trigrams)}
    words = range(len(trigrams) // 63 + 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("trigram") % 63)
    per = index.groupBy("doc_id").agg(*[F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, bit).otherwise(F.lit(0))).alias(f"held{w}") for w in words])
    rules = F.lit(0).cast("long")
    for k, q in enumerate(queries):
        met = F.lit(False)
        for needed in sorted(q, key=sorted):
            bits = {w: sum(1 << at[t][1] for t in needed if at[t][0] == w) for w in words}
            all_held = F.lit(True)
            for w, x in bits.items():
                all_held = all_held & (F.col(f"held{w}").bitwiseAND(F.lit(x)) == F.lit(x)) if x else all_held
            met = met | all_held
        rules = rules + F.when(met, F.lit(1 << k)).otherwise(F.lit(0))
    return per.select("doc_id", rules.alias("rules")).filter("rules > 0")


#: Lengths that one block adds up, and levels of blocks; the sums over the highest have a part for FAN ** LEVELS matches.
FAN, LEVELS = 64, 2


def _bind(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(xs: Column, begin: Column, n: Column) -> Column:
    """The sum of n numbers from place begin on, which counts from 0."""
    return F.aggregate(F.slice(xs, begin + 1, n), F.lit(0), lambda a, b: a + b)


def _sums(level: int, xs: Column, body) -> Column:
    """body(f) where f(i) is the sum of the first i of xs; f adds fewer than FAN parts on each level."""
    if not level:
        return body(lambda i: _total(xs, F.lit(0), i))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / FAN).cast("int"))), lambda k: _total(xs, k * FAN, F.lit(FAN)))
    return _bind(blocks, lambda ys: _sums(level - 1, ys, lambda f: body(lambda i: f(F.floor(i / FAN).cast("int")) + _total(xs, i - i % FAN, i % FAN))))


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in the text: an array of (start, order, kind, end), in code points, the end exclusive."""
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    lengths = lambda group: F.transform(F.regexp_extract_all(text, pattern, F.lit(group)), F.length)

    def spans(whole: Column) -> Column:
        between = F.transform(F.split(text, rule.pattern, -1), F.length)

        def placed(both: Column) -> Column:
            """both: per match the piece before it, its length, and that of the group that counts."""

            def span(f):
                each = F.transform(both, lambda x, i: F.struct((f(i) + x["0"]).alias("start"), x["1"].alias("length"), x["2"].alias("counted")))
                kept = F.filter(each, lambda x: x["counted"] >= rule.least)
                return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (x["start"] + x["length"]).alias("end")))

            return _bind(F.transform(both, lambda x: x["0"] + x["1"]), lambda steps: _sums(LEVELS, steps, span))

        counted = lengths(rule.group) if rule.group else whole
        zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("0"), whole.alias("1"), counted.alias("2"))
        return F.when(F.size(whole) > 0, _bind(zipped, placed)).otherwise(none)

    return _bind(lengths(0), spans)


def longest_first(rule: Rule) -> Rule:
    """A rule that is a single run of one class may ask for the least length at once: any run that is long enough is
    matched as a whole, and shorter ones would be dropped. The same holds after a prefix of the same class."""
    m = sre_parse.parse(rule.pattern)
    if not rule.group and rule.least and len(m) == 1 and m[0][0] is sre.MAX_REPEAT and rule.pattern.endswith("+"):
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.base)
    return rule


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_<kind> of each base rule, base_sha256, spans.

    Null text counts as empty. Rows with a null id aren't in the index and are scanned by every rule where they lie; rows
    that repeat an id share its postings, and each is verified on its own text. Other columns are ignored.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("kinds repeat")
    queries = [trigram_query(r.pattern) for r in rules]
    scanned = [q == ALWAYS or frozenset() in q for q in queries]
    trigrams = sorted({t for q, scan in zip(queries, scanned) if not scan for alt in q for t in alt})
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    indexed = [i for i, scan in enumerate(scanned) if not scan]
    index = materialise(postings(texts.filter(F.col("doc_id").isNotNull()), trigrams), "trigrams")
    chosen = candidates(index, [queries[i] for i in indexed], trigrams)
    looked = texts.filter(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    looked = looked.unionByName(texts.filter(F.col("doc_id").isNull()).withColumn("rules", F.lit((1 << len(indexed)) - 1).cast("long")))

    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int>>")
    found = []
    for k, (rule, scan) in enumerate(zip(rules, scanned)):
        spans = rule_spans(F.col("text"), longest_first(rule), k)
        if not scan:
            spans = F.when(F.col("rules").bitwiseAND(F.lit(1 << indexed.index(k))) != 0, spans).otherwise(none)
        found.append(spans.alias(f"s{k}"))
    looked = looked.select("doc_id", *found)
    told = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = [f"s{k}" for k, r in enumerate(rules) if r.base]
    return looked.select(
        "doc_id",
        *[F.size(f"s{k}").cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base],
        F.sha2(told(F.concat(*base)).cast("binary"), 256).alias("base_sha256"),
        told(F.concat(*[f"s{k}" for k in range(len(rules))])).alias("spans"),
    )
