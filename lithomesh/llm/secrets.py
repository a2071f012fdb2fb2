"""Secret scans with Spark expressions only.

Three base patterns find labelled secrets, access keys and long hexadecimal
runs. Beside them every long token that mixes letters and digits goes through a
battery of randomness tests for the encoding that its alphabet suggests: a
chi-squared test of uniform use of the alphabet, a runs test and a serial
correlation test. No encoding has both one of ``+/`` and one of ``_-``: a token
with both, as a key behind a path, is tested whole over all these characters, and
cut at the former and at the latter, in parts of 20 characters or more that mix
letters and digits; so spans may overlap. Tokens that fail are ordinary text. Which p-values count as
failures is decided for each encoding and band of lengths by the
Benjamini-Hochberg procedure over the tokens of the whole corpus, so that short
tokens, on which the tests say little, are not judged by the crowd of long ones;
what passes is reported as kind ``random``, also inside base spans.

All steps are linear in a text's length, in its number of matches and in the
length of a token: positions are running sums over blocks of blocks, and tokens and
texts are cut into blocks before single characters are taken from them.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithomesh.plans.session import bound_parser_caches
from lithomesh.plans.storage import materialise

# The base kinds in their order, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

#: Tokens that are tested: 20 characters or more, 80 bits or more if they were random.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Parts of tokens that no encoding fits: between +/, and between _-.
PARTS = (r"[A-Za-z0-9_-]{20,}", r"[A-Za-z0-9+/]{20,}")
#: Share of random tokens that may be taken for text.
FDR = 0.05
#: Cells of the chi-squared test; with 9 its survival function has a closed form.
CELLS = 9
#: Characters of a token, and of a text, that are taken apart at once.
TOKEN_BLOCK, TEXT_BLOCK = 4096, 1024
#: Values of a block of a running sum.
RUN_BITS = 5
RUN = 1 << RUN_BITS
#: Bins of p-values for each factor of ten, and the last bin.
BINS, LAST_BIN = 20, 240

#: Encodings by the first that fits: name, pattern, alphabet.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", string.digits + "abcdef"),
    ("HEX", "^[0-9A-F]+$", string.digits + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    ("base62", "^[A-Za-z0-9]+$", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", "^[A-Za-z0-9+/]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", "^[A-Za-z0-9_-]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
    ("mixed", "^[A-Za-z0-9+/_-]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_"),
)


# Expressions are built as SQL text: nested lambdas cost a call to the JVM for each node otherwise.


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, then: str) -> str:
    """``then``, in which ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {then})[0]"


def _running(values: str, combine: str, levels: int = 3) -> str:
    """For each of some non-negative integers what ``combine`` makes of those before it, 0 for the first.

    Arrays have no expression for it that does not copy what it has for every
    value; so totals of blocks are run over first, level by level, and each value
    adds those of its own block. ``values`` is a column or a lambda's variable, and
    ``combine`` is of ``a`` and ``b``.
    """

    def over(low: str, high: str, start: str) -> str:
        """Combination of values low to high - 1."""
        step = combine.replace("{b}", f"{values}[j]")
        return f"if({high} > {low}, aggregate(sequence({low}, greatest({low}, {high} - 1)), {start}, (a, j) -> {step}), {start})"

    one_by_one = f"transform({values}, (x, i) -> {over('0', 'i', '0')})"
    if not levels:
        return one_by_one
    totals = f"transform(sequence(0, shiftright(greatest(size({values}) - 1, 0), {RUN_BITS})), k -> {over(f'k * {RUN}', f'least(size({values}), (k + 1) * {RUN})', '0')})"
    t, before = f"t{levels}", f"o{levels}"
    placed = f"transform({values}, (x, i) -> {over(f'i - i % {RUN}', 'i', f'{before}[shiftright(i, {RUN_BITS})]')})"
    of_blocks = _let(t, totals, _let(before, _running(t, combine, levels - 1), placed))
    return f"if(size({values}) <= {RUN}, {one_by_one}, {of_blocks})"


def _located(text: str, pattern: str) -> str:
    """array of (start, end, match) in code points, end exclusive, of leftmost non-overlapping matches."""
    placed = "transform(found, (m, i) -> named_struct('start', before[i] + length(between[i]), 'end', before[i] + strides[i], 'match', m))"
    strided = _let("strides", "transform(found, (m, i) -> length(between[i]) + length(m))", _let("before", _running("strides", "a + {b}"), placed))
    some = _let("between", f"split({text}, {_quoted(pattern)}, -1)", strided)
    return _let("found", f"regexp_extract_all({text}, {_quoted(pattern)}, 0)", f"if(size(found) > 0, {some}, cast(array() as array<struct<start:int,end:int,match:string>>))")


def _mixes(c: str) -> str:
    return f"{c}.match rlike '[A-Za-z]' and {c}.match rlike '[0-9]'"


def _parts(c: str) -> str:
    """What is tested of a token: itself, and its parts where no encoding fits."""
    parts = [f"transform({_located(f'{c}.match', p)}, m -> named_struct('start', {c}.start + m.start, 'end', {c}.start + m.end, 'match', m.match))" for p in PARTS]
    # no part is one by both cuts: it would end at a mark of both kinds
    return f"if({c}.match rlike '[+/]' and {c}.match rlike '[_-]', concat(array({c}), filter(concat({', '.join(parts)}), p -> {_mixes('p')})), array({c}))"


def _case(of: str, values: dict[str, str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _two_sided(z: str) -> str:
    """Two-sided normal p-value by a rational approximation of erfc (error under 2e-7)."""
    x = f"(abs({z}) / {math.sqrt(2)!r}D)"
    t = f"(1 / (1 + 0.3275911D * {x}))"
    poly = f"({t} * (0.254829592D + {t} * (-0.284496736D + {t} * (1.421413741D + {t} * (-1.453152027D + {t} * 1.061405429D)))))"
    return f"greatest({poly} * exp(-{x} * {x}), 1e-12D)"


def _spans(docs: DataFrame, text: Column) -> DataFrame:
    """Base spans and tested tokens of each row: columns ``assign``, ``access``, ``hex`` and ``tokens``."""
    bound_parser_caches(docs.sparkSession)
    located = (
        docs.withColumn("_t", text)
        .withColumn("assign", F.expr(f"filter({_located('_t', ASSIGN)}, m -> length(regexp_extract(m.match, {_quoted(ASSIGN)}, 2)) >= {ASSIGN_VALUE})"))
        .withColumn("access", F.expr(f"filter({_located('_t', ACCESS)}, m -> length(m.match) >= {ACCESS_LENGTH})"))
        .withColumn("hex", F.expr(_located("_t", HEX)))
        .withColumn("tokens", F.expr(f"flatten(transform(filter({_located('_t', TOKEN)}, c -> {_mixes('c')}), c -> {_parts('c')}))"))
    )
    patterns = "CASE " + " ".join(f"WHEN c.match RLIKE '{p}' THEN '{name}'" for name, p, _ in ENCODINGS) + " END"
    alphabets = _case("c.kind", {name: f"'{a}'" for name, _, a in ENCODINGS})
    shares = {name: "array(" + ", ".join(f"{sum(v * CELLS // len(a) == j for v in range(len(a))) / len(a)!r}D" for j in range(CELLS)) + ")" for name, _, a in ENCODINGS}
    # of a block of values: first and last, sum, sum of squares, sum of products of neighbours, values in the upper half, changes of half, values in each cell
    walk = (
        "aggregate(v, named_struct('last', -1, 's', 0L, 'q', 0L, 'p', 0L, 'upper', 0, 'changes', 0), (a, x) -> named_struct('last', x, 's', a.s + x, 'q', a.q + x * x, 'p', a.p + if(a.last < 0, 0, a.last * x),"
        " 'upper', a.upper + if(2 * x >= c.size, 1, 0), 'changes', a.changes + if(a.last >= 0 and (2 * x >= c.size) <> (2 * a.last >= c.size), 1, 0)))"
    )
    block = f"named_struct('first', v[0], 'w', {walk}, 'cells', transform(sequence(0, {CELLS - 1}), j -> size(filter(v, x -> x * {CELLS} div c.size = j))))"
    merge = (
        "aggregate(c.blocks, named_struct('last', -1, 's', 0L, 'q', 0L, 'p', 0L, 'upper', 0, 'changes', 0, 'cells', array_repeat(0, " + str(CELLS) + ")), (a, b) -> named_struct('last', b.w.last, 's', a.s + b.w.s, 'q', a.q + b.w.q,"
        " 'p', a.p + b.w.p + if(a.last < 0, 0, a.last * b.first), 'upper', a.upper + b.w.upper, 'changes', a.changes + b.w.changes + if(a.last >= 0 and (2 * b.first >= c.size) <> (2 * a.last >= c.size), 1, 0),"
        " 'cells', zip_with(a.cells, b.cells, (x, y) -> x + y)))"
    )
    steps = [
        f"transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'match', c.match, 'n', length(c.match), 'kind', {patterns}))",
        f"transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'match', c.match, 'kind', c.kind, 'n', c.n, 'alphabet', {alphabets}, 'size', length({alphabets})))",
        f"transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'n', c.n, 'size', c.size, 'blocks',"
        f" transform(regexp_extract_all(c.match, '.{{1,{TOKEN_BLOCK}}}', 0), m -> transform(array(transform(split(m, ''), x -> instr(c.alphabet, x) - 1)), v -> {block})[0])))",
        f"transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'n', c.n, 'size', c.size, 'first', c.blocks[0].first, 'w', {merge}))",
        "transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'n', c.n, 'runs', 1 + c.w.changes,"
        " 'expected', 2D * c.w.upper * (c.n - c.w.upper) / c.n + 1,"
        " 'mean', c.w.s / c.n, 'var', c.w.q - cast(c.w.s as double) * c.w.s / c.n,"
        " 'products', c.w.p, 'ends', 2D * c.w.s - c.first - c.w.last,"
        f" 'half', (aggregate(zip_with(c.w.cells, {_case('c.kind', shares)}, (k, e) -> power(k, 2) / (c.n * e)), 0D, (s, x) -> s + x) - c.n) / 2))",
        "transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'kind', c.kind, 'n', c.n,"
        " 'uniform', greatest(exp(-c.half) * (1 + c.half + power(c.half, 2) / 2 + power(c.half, 3) / 6), 1e-12D),"
        f" 'alternating', if(c.expected > 2, {_two_sided('((c.runs - c.expected) / sqrt((c.expected - 1) * (c.expected - 2) / (c.n - 1)))')}, 1e-12D),"
        f" 'serial', if(c.var > 0, {_two_sided('((c.products - c.mean * c.ends + (c.n - 1) * c.mean * c.mean) / if(c.var > 0, c.var, 1D) * sqrt(c.n))')}, 1e-12D)))",
        f"transform(tokens, c -> named_struct('start', c.start, 'end', c.end, 'stratum', concat(c.kind, ':', cast(floor(2 * log2(c.n)) as string)),"
        f" 'bin', cast(least({LAST_BIN}, floor(-{BINS} * log10(least(1D, 3 * least(c.uniform, c.alternating, c.serial))))) as int)))",
    ]
    for step in steps:
        located = located.withColumn("tokens", F.expr(step))
    return located


def cutoffs(spans: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """For each stratum the least bin of p-values that counts as text.

    The counts cover all tokens. A stratum is an encoding and a band of lengths
    and has a bounded number of bins, so what comes to the driver is bounded.
    """
    counts = spans.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").agg(F.count(F.lit(1)).alias("n")).collect()
    strata: dict[str, dict[int, int]] = {}
    for row in counts:
        strata.setdefault(row["stratum"], {})[row["bin"]] = row["n"]
    out = {}
    for stratum, bins in strata.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 10 ** (-b / BINS) <= fdr * seen / total:
                out[stratum] = b
    return out


def _random(found: dict[str, int]) -> Column:
    """The tokens that pass: below their stratum's cut-off."""
    table = F.create_map(*[F.lit(x) for pair in found.items() for x in pair]) if found else F.expr("cast(map() as map<string,int>)")
    return F.filter(F.col("tokens"), lambda c: c["bin"] < F.coalesce(F.try_element_at(table, c["stratum"]), F.lit(LAST_BIN + 1)))


def _text(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[f"`{text_col}`"], F.lit(""))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the spans of each kind: ``assign``, ``access``, ``hex``, ``random`` (arrays of start, end).

    Starts and ends count code points. A null text counts as empty and has no
    spans; repeated rows and null ids stay as they are; an empty table gives an
    empty result; other columns are ignored. Very long texts and tokens are scanned
    whole, in time linear in their length. The texts are read once; what is
    found in them is written to the shared folder, without the texts.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("id"), _text(docs, text_col).alias("_text"))
    plain = lambda c: F.transform(F.col(c), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    found = materialise(_spans(named, F.col("_text")).select("id", *[plain(c).alias(c) for c in ("assign", "access", "hex")], "tokens"), "secret-spans")
    return found.withColumn("tokens", _random(cutoffs(found))).select(F.col("id").alias(id_col), "assign", "access", "hex", plain("tokens").alias("random"))


def _masked(text: str, spans: str, mask: str) -> str:
    """``text`` with ``mask`` for each union of the spans, which are in order and at least one."""
    block = TEXT_BLOCK

    def piece(low: str, high: str) -> str:
        """Code points low to high - 1, from the text's blocks."""
        part = f"substring(blocks[k], greatest({low} - k * {block}, 0) + 1, least({high} - k * {block}, {block}) - greatest({low} - k * {block}, 0))"
        return f"if({high} > {low}, array_join(transform(sequence({low} div {block}, greatest({low}, {high} - 1) div {block}), k -> {part}), ''), '')"

    begins = "filter(sequence(0, size(spans) - 1), i -> spans[i].start >= reached[i])"
    masked = f"array_join(transform({begins}, i -> concat({piece('reached[i]', 'spans[i].start')}, {_quoted(mask)})), '')"
    out = f"concat({masked}, {_let('top', 'array_max(transform(spans, x -> x.end))', piece('top', f'length({text})'))})"
    reached = _let("ends", f"transform({spans}, x -> x.end)", _running("ends", "greatest(a, {b})"))
    return _let("blocks", f"regexp_extract_all({text}, '(?s).{{1,{block}}}', 0)", _let("spans", spans, _let("reached", reached, out)))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The input's rows with every span of every kind replaced by ``mask``; overlapping spans are one.

    Rows without a span stay as they are, null and empty texts and repeated rows
    among them; an empty table stays empty. A column ``n_chars`` of the input is
    set to the new text's length where a text changed; all others are kept, whatever
    their names. Texts are read twice and not shuffled: once for the corpus counts
    and once to replace.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = names[docs.columns.index(text_col)]
    renamed = docs.toDF(*names)
    text = F.coalesce(F.col(at), F.lit(""))
    found = cutoffs(_spans(renamed.select(at), text).select("tokens"))
    marked = (
        _spans(renamed, text)
        .withColumn("tokens", _random(found))
        .withColumn("_spans", F.expr("array_sort(concat(" + ", ".join(f"transform({c}, m -> named_struct('start', m.start, 'end', m.end))" for c in ("assign", "access", "hex", "tokens")) + "))"))
    )
    marked = marked.withColumn("_out", F.expr(f"if(size(_spans) > 0, {_masked('_t', '_spans', mask)}, _t)"))
    new = F.when(F.size("_spans") > 0, F.col("_out")).otherwise(F.col(at))
    out = [new if n == at else F.when(F.size("_spans") > 0, F.length("_out").cast(f.dataType)).otherwise(F.col(n)) if f.name == "n_chars" else F.col(n) for n, f in zip(names, docs.schema.fields)]
    return marked.select(*[c.alias(f.name) for c, f in zip(out, docs.schema.fields)])


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of spans by start, then kind in the order given, comma-joined."""
    tagged = [f"transform({c}, s -> named_struct('start', s.start, 'order', {i}, 'end', s.end, 'kind', '{c}'))" for i, c in enumerate(kinds)]
    return F.expr(f"array_join(transform(array_sort(concat({', '.join(tagged)})), s -> concat(s.kind, ':', cast(s.start as string), ':', cast(s.end as string))), ',')")


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = ["assign", "access", "hex"]
    return found.select(
        "doc_id",
        *[F.size(c).cast("long").alias(f"n_{c}") for c in base],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed([*base, "random"]).alias("spans"),
    )
