"""Personal data by weak supervision, in DataFrame functions alone.

Patterns propose candidate spans. Four labelers vote on each: the pattern's own validity check, a gazetteer (top-level
domains, calling codes, issuer digits, routable networks), words in the context before the span, and whether the span
stands alone. Expectation-maximisation estimates how reliable each labeler is for each kind, without labels; it is one
SQL fold over the counts of vote patterns (16 for each kind at most). Its posteriors are soft labels for the final
span classifier, a naive Bayes model over votes and span lengths. Valid spans always stay; the classifier adds others.

Offsets are code points. Matches are found by ``regexp_extract_all``, their places by the lengths of what ``split`` leaves
between them; both scan leftmost without overlap. Separators that may stand only between two characters of a span are
first replaced, one for one, by private-use characters, so that patterns are single character loops: no
backtracking into long runs, no recursion in the regex engine, linear time on very long texts.

Running sums and maxima over a text's matches are made in blocks (``_scan``), and context is taken from the pieces between matches: the time
for a text grows in proportion to its length and matches, as long as these are under a few hundred thousand.

Defined cases: a null text is empty: no spans; repeated rows give repeated results; an empty table gives no rows and no model; a null
identifier is passed on; matches of one kind never overlap, the leftmost stays; other columns are ignored, whatever their names; very
long texts are read whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import documents, saved, with_text

KINDS = ("email", "ip", "card", "phone")
_DOT, _GAP = "", ""
_SPAN = "array<struct<k:int,s:int,e:int>>"
_FOUND = "array<struct<k:int,s:int,e:int,m:string,b:string,x:string>>"
#: Gazetteers and context words.
TLDS = "com org net edu gov mil int info io co de fr es it uk us eu ch at nl be pl ru cn jp in br ca au mx"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CONTEXT = {
    "email": "e-?mail|contact|kontakt|correo|courriel|write|reply|address",
    "ip": "\\\\bip\\\\b|server|host|addr|login|network|client",
    "card": "card|visa|credit|debit|karte|carte|tarjeta|payment|account|konto",
    "phone": "phone|tel\\\\b|tel[.:]|call|fax|mobile|anruf|appel|llam|\\\\+[0-9]{1,3} ?$",
}
_LOCAL, _LABEL = "A-Za-z0-9._%+" + _DOT + "-", "A-Za-z0-9-"
#: kind, what holds if a text can have one, the text with private separators, the pattern
_PATTERNS = (
    (0, "instr(text, '@') > 0", f"regexp_replace(translate(text, '{_DOT}', '#'), r'(?<=[{_LABEL}])\\.(?=[{_LABEL}])', '{_DOT}')",
     f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[{_LABEL}]++{_DOT}[A-Za-z0-9{_DOT}-]++"),
    (1, "text rlike r'[0-9]\\.[0-9]'", "text", "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"),
    (2, "text rlike r'[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", f"regexp_replace(translate(text, '{_GAP}', '#'), r'(?<=[0-9])[ -](?=[0-9])', '{_GAP}')", f"[0-9][0-9{_GAP}]++"),
    (3, "instr(text, '+') > 0", "text", "\\+[0-9][ ().0-9-]+[0-9]"),
    (4, "text rlike r'[0-9][ -][0-9]{3}-[0-9]{4}' or text rlike r'[0-9]\\)[ -][0-9]{3}-[0-9]{4}'", "text", "\\(?[0-9]{3}\\)?[ -][0-9]{3}-[0-9]{4}(?![0-9])"),
)


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _scan(values: str, merge: str, start: str) -> str:
    """SQL for the array of what ``merge`` (of x and y) makes of all values before each one, from ``start`` on.

    In blocks of 64: arrays that grow by one element are short, so that time stays in proportion to the length.
    """
    grow = "aggregate({values}, named_struct('now', {start}, 'out', filter(array({start}), z -> false)), (x, y) -> named_struct('now', {merge}, 'out', concat(x.out, array(x.now))), x -> x.out)"
    step = merge.replace("x", "x.now")
    blocks = f"transform(sequence(0, div(size(v), 64)), i -> slice(v, 64 * i + 1, 64))"
    totals = f"transform(b, q -> aggregate(q, {start}, (x, y) -> {merge}))"
    each = grow.format(values="q", start="t[i]", merge=step)
    return _let("v", values, _let("b", blocks, _let("t", grow.format(values=totals, start=start, merge=step), f"flatten(transform(b, (q, i) -> {each}))")))


def _occurrences(k: int, gate: str, text: str, pattern: str) -> str:
    """SQL for all matches: kind, start, end, what matches (m), up to 40 characters before (b), and the one after (x)."""
    back = {0: f"translate({{}}, '{_DOT}', '.')", 2: f"translate({{}}, '{_GAP}', ' ')"}.get(k, "{}")
    before = "right(concat(if(i > 0, q[i - 1], ''), p[i]), 40)"
    after = "left(concat(p[i + 1], if(i + 1 < size(q), q[i + 1], '')), 1)"
    one = (f"named_struct('k', {k}, 's', at[i] + length(p[i]), 'e', at[i] + length(p[i]) + length(m), 'm', {back.format('m')}, 'b', lower({back.format(before)}), 'x', {back.format(after)})")
    sums = _scan("transform(q, (m, i) -> length(p[i]) + length(m))", "x + y", "0")
    body = _let("p", f"split(t, r'{pattern}', -1)", _let("q", f"regexp_extract_all(t, r'{pattern}', 0)", _let("at", sums, f"transform(q, (m, i) -> {one})")))
    return f"if({gate}, {_let('t', text, body)}, cast(array() as {_FOUND}))"


_DIGITS = "regexp_replace(m, r'[^0-9]', '')"
_LUHN = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + {v} * if(i % 2 = 0, 2, 1) - if(i % 2 = 0 and {v} > 4, 9, 0)) % 10 = 0".format(v="cast(substr(reverse(d), i, 1) as int)")
_VALID = (
    "case c.k when 0 then true when 1 then m rlike r'^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$' "
    f"when 2 then {_let('d', _DIGITS, f'if(length(d) between 13 and 19, {_LUHN}, false)')} when 3 then length({_DIGITS}) between 9 and 15 else false end")
_GAZETTEER = (
    f"case c.k when 0 then array_contains(split('{TLDS}', ' '), lower(regexp_extract(m, r'([A-Za-z0-9-]*)$', 1))) when 1 then not m rlike r'^0*(0|10|127|2[2-5][0-9])\\.' "
    f"when 2 then m rlike r'^(4|5[1-5]|2[2-7]|3[47]|6)' when 3 then exists(split('{CALLING_CODES}', ' '), x -> startswith(substr(m, 2), x)) else true end")
_CONTEXT = "case c.k when 0 then b rlike '{email}' when 1 then b rlike '{ip}' when 2 then b rlike '{card}' else b rlike '{phone}' end".format(**CONTEXT)
_ALONE = "not b rlike r'[\\p{L}0-9]$' and not c.x rlike r'[\\p{L}0-9]'"
VOTES = 4


def candidates(docs: DataFrame, **cols) -> DataFrame:
    """(doc_id, spans): every candidate of a whole text as (k, s, e, base, v: votes, size bucket)."""
    base = with_text(docs, **cols)
    raw = base.withColumn("found", F.expr("concat(" + ", ".join(_occurrences(*x) for x in _PATTERNS) + ")"))
    made = ("named_struct('k', if(c.k = 4, 3, c.k), 's', c.s, 'e', c.e, 'base', {valid}, 'digits', length({digits}), "
            "'v', array(cast({valid} as int), cast({gazetteer} as int), cast({context} as int), cast({alone} as int)))")
    made = made.format(valid=_VALID, digits=_DIGITS, gazetteer=_GAZETTEER, context=_CONTEXT, alone=_ALONE)
    one = _let("m", "c.m", _let("b", "c.b", made))
    # numbers of fewer than 12 digits can't be cards
    told = raw.select("doc_id", F.expr(f"if(size(found) = 0, null, filter(transform(found, c -> {one}), c -> c.k <> 2 or c.base or c.digits between 12 and 19))").alias("spans"))
    return told


_LIKE = "{prior} * aggregate(sequence(0, %d), 1D, (s, j) -> s * if(p.v[j] = 1, m.{x}[j], 1D - m.{x}[j]))" % (VOTES - 1)
_R = "({one} / ({one} + {none}))".format(one=_LIKE.format(prior="m.pi", x="a"), none=_LIKE.format(prior="(1D - m.pi)", x="b"))


def _em(rounds: int = 25) -> str:
    """SQL over ``pats`` (vote patterns v with counts n): prior pi, and votes' rates a among true spans, b among others."""
    total = "aggregate(q, 0D, (s, x) -> s + {w} * x.n)"
    rate = "transform(sequence(0, %d), j -> (aggregate(q, 0D, (s, x) -> s + {w} * x.n * x.v[j]) + {up}D) / (aggregate(q, 0D, (s, x) -> s + {w} * x.n) + 2D))" % (VOTES - 1)
    step = ("named_struct('pi', (" + total.format(w="x.r") + " + 1D) / (" + total.format(w="1D") + " + 2D), 'a', " + rate.format(w="x.r", up="1.2") + ", 'b', " + rate.format(w="(1D - x.r)", up="0.5") + ")")
    weighted = f"transform(pats, p -> named_struct('v', p.v, 'n', p.n, 'r', {_R}))"
    start = "named_struct('pi', 0.7D, 'a', array(0.95D, 0.8D, 0.4D, 0.9D), 'b', array(0.05D, 0.4D, 0.1D, 0.5D))"
    return f"aggregate(sequence(1, {rounds}), {start}, (m, i) -> {_let('q', weighted, step)})"


_BUCKET = "least(10, div(e - s, 4))"


def train(spans: DataFrame) -> list[Row]:
    """A row for each kind: reliabilities by expectation-maximisation, and the log-odds of span lengths under its posteriors."""
    each = spans.where("spans is not null").selectExpr("inline(spans)").groupBy("k", "v", F.expr(_BUCKET).alias("bucket")).agg(F.count("*").alias("n"))
    models = each.groupBy("k", "v").agg(F.sum("n").alias("n")).groupBy("k").agg(F.collect_list(F.struct("v", "n")).alias("pats")).select("k", F.expr(_em()).alias("m"))
    soft = each.withColumnRenamed("n", "many").selectExpr("k", "bucket", "many", "named_struct('v', v) as p").join(models, "k").withColumn("r", F.expr(_R))
    sized = soft.groupBy("k", "bucket").agg(F.sum(F.col("r") * F.col("many")).alias("yes"), F.sum((1 - F.col("r")) * F.col("many")).alias("no"))
    sums = sized.groupBy("k").agg(F.sum("yes").alias("y"), F.sum("no").alias("n"), F.collect_list(F.struct("bucket", "yes", "no")).alias("sizes"))
    odds = sums.selectExpr("k", "transform(sequence(0, 10), i -> ln((coalesce(get(filter(sizes, x -> x.bucket = i), 0).yes, 0D) + 0.5D) / (y + 5.5D)) - ln((coalesce(get(filter(sizes, x -> x.bucket = i), 0).no, 0D) + 0.5D) / (n + 5.5D))) as sizes")
    return models.join(odds, "k").select("k", "m.pi", "m.a", "m.b", "sizes").collect()  # four rows


def _score(model: list[Row]) -> str:
    """SQL for the log-odds that candidate ``c`` is personal data."""
    number = lambda x: f"{x!r}D"
    parts = []
    for r in model:
        votes = " + ".join(f"if(c.v[{j}] = 1, {number(math.log(a / b))}, {number(math.log((1 - a) / (1 - b)))})" for j, (a, b) in enumerate(zip(r.a, r.b)))
        parts.append(f"when {r.k} then {number(math.log(r.pi / (1 - r.pi)))} + {votes} + array({', '.join(map(number, r.sizes))})[least(10, div(c.e - c.s, 4))]")
    return f"case c.k {' '.join(parts)} end" if parts else "0D"


def find(docs: DataFrame, accept: float = 0.95, **cols) -> DataFrame:
    """(doc_id, base, spans): arrays of (k, s, e), k an index into ``KINDS``, by kind and start.

    accept: the classifier's probability from which a span that fails its validity check is added.
    """
    spans = saved(candidates(docs, **cols))
    score = _score(train(spans))
    plain = "x -> named_struct('k', x.k, 's', x.s, 'e', x.e)"
    none = f"cast(array() as {_SPAN})"
    told = spans.selectExpr("doc_id", f"coalesce(array_sort(transform(filter(spans, c -> c.base), {plain})), {none}) as base", f"coalesce(transform(filter(spans, c -> not c.base and {score} > {math.log(accept / (1 - accept))!r}D), {plain}), {none}) as more")
    # of all spans in order of their starts, base ones first: those that no base span before reaches, nor one after begins in
    both = "array_sort(concat(transform(base, x -> named_struct('s', x.s, 'more', 0, 'e', x.e, 'k', x.k)), transform(more, x -> named_struct('s', x.s, 'more', 1, 'e', x.e, 'k', x.k))))"
    reach = _scan("transform(z, c -> if(c.more = 0, c.e, 0))", "greatest(x, y)", "0")
    ahead = f"reverse({_scan('transform(reverse(z), c -> if(c.more = 0, c.s, 2147483647))', 'least(x, y)', '2147483647')})"
    free = "transform(filter(transform(z, (c, i) -> named_struct('c', c, 'free', c.more = 1 and r[i] <= c.s and a[i] >= c.e)), w -> w.free), w -> named_struct('k', w.c.k, 's', w.c.s, 'e', w.c.e))"
    fresh = _let("z", both, _let("r", reach, _let("a", ahead, free)))
    return told.selectExpr("doc_id", "base", f"if(size(more) = 0, base, array_sort(concat(base, {fresh}))) as spans")


def query(spark, sf_dir: str) -> DataFrame:
    names = "array({})".format(", ".join(f"'{k}'" for k in KINDS))
    line = "array_join(transform({x}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')"
    counts = [f"cast(size(filter(base, x -> x.k = {k})) as bigint) as n_{kind}" for k, kind in enumerate(KINDS)]
    return find(documents(spark, sf_dir)).selectExpr("doc_id", *counts, f"sha2({line.format(x='base', names=names)}, 256) as base_sha256", f"{line.format(x='spans', names=names)} as spans")
