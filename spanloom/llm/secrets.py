"""Secrets in texts: fixed patterns, and strings that a battery of randomness tests takes for keys.

DataFrame functions only. Positions count code points, ends exclusive.

The patterns give the base spans. Besides, every run of 20 or more letters, digits and ``+ / _ = -``
that has both letters and digits is tested under the encoding it fits best (hex, base 32, base 64).
The null hypothesis is that it is an ordinary string, a name or a number, and each test gives the chance
that an ordinary string looks as random as this one does: chi-squared for even use of the alphabet (ordinary
strings prefer some symbols), runs of letters of a case or of digits (ordinary strings change seldom), and
serial correlation of neighbouring symbols (theirs isn't zero). At least two of the three must speak for
a key: the string's chance is twice the middle one of the three, which no single odd test can bring down.
All three count symbols, so a short string needs to look far more random than a long one.

Reports are controlled by Benjamini and Hochberg's procedure at level ``FALSE`` within each encoding and
length class, so of the strings reported as ``random`` about that share at most are ordinary. Chances are
counted in bins, so that a class of any size comes down to a few hundred numbers. A candidate that
overlaps a base span adds nothing and isn't reported twice.

Places of matches and spans are running sums and maxima, taken in chunks: the work for a text grows with
its length and its number of matches, not with their square. A null text counts as empty; empty texts and
tables have no spans. Repeated rows, and rows whose id is null, are each reported on their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import spread, stored

#: The base patterns, in the order in which spans that start together are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 6
FALSE = 0.05
BINS_A_DECADE, LAST_BIN = 10, 300
ALPHABETS = {"hex": "0123456789abcdef", "b32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "b64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Fixed values for ordinary strings: how far from even they use the alphabet (its size times the chance that two symbols
#: are equal, less 1: decimal digits alone in hex, letters about as in prose in base 32, letters of one case in base 64),
#: and how often a symbol is of another class than the one before (random strings: .47, .31, .65).
ORDINARY = {"hex": (0.6, 0.2), "b32": (0.76, 0.15), "b64": (1.46, 0.3)}
#: Fixed value: how far from zero the serial correlation of ordinary strings is.
SERIAL = 0.3
#: Numbers that a running sum takes one after the other; sums of such chunks are then added up.
CHUNK = 256


def running(df: DataFrame, totals: dict[str, tuple[str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """df with arrays of the running totals of arrays of whole numbers from 0 up, by sum or maximum: output: (input, more).

    Arrays are zipped with what they need, not looked up from inside: Spark might work such a lookup out for each element.
    """
    none = F.from_json(F.lit('{"out":[],"at":0}'), "out array<int>, at int")

    def fold(array: Column, of, more) -> Column:
        return F.aggregate(array, none, lambda acc, x: F.struct(F.array_append(acc["out"], more(acc["at"], of(x))).alias("out"), more(acc["at"], of(x)).alias("at")))

    def parts(column: str, more) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice(column, i + 1, CHUNK))
        return F.transform(chunks, lambda p: fold(p, lambda x: x, more))

    def joined(out: str, more) -> Column:
        before = F.concat(F.array(F.lit(0)), fold(F.col(f"_parts_{out}"), lambda x: x["at"], more)["out"])
        return F.flatten(F.zip_with(f"_parts_{out}", F.slice(before, F.lit(1), F.size(f"_parts_{out}")), lambda p, b: F.transform(p["out"], lambda x: more(x, b))))

    df = df.withColumns({f"_parts_{out}": parts(column, more) for out, (column, more) in totals.items()})
    return df.withColumns({out: joined(out, more) for out, (_, more) in totals.items()}).drop(*(f"_parts_{out}" for out in totals))


def added(a: Column, b: Column) -> Column:
    return a + b


def located(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """df with array<struct<start, end, found>> for each pattern: its leftmost non-overlapping matches. No pattern may match the empty string."""
    t, none = F.col(text), F.array().cast("array<string>")
    found = {f"_found_{n}": F.when(t.rlike(p), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(none) for n, p in patterns.items()}
    gaps = {f"_gaps_{n}": F.when(t.rlike(p), F.split(t, p, -1)).otherwise(none) for n, p in patterns.items()}
    df = df.withColumns(found | gaps)
    df = df.withColumns({f"_n_{n}": F.zip_with(f"_found_{n}", F.slice(f"_gaps_{n}", F.lit(1), F.size(f"_found_{n}")), lambda x, gap: F.char_length(gap) + F.char_length(x)) for n in patterns})
    df = running(df, {f"_end_{n}": (f"_n_{n}", added) for n in patterns})
    spans = lambda n: F.zip_with(f"_found_{n}", f"_end_{n}", lambda x, e: F.struct((e - F.char_length(x)).alias("start"), e.alias("end"), x.alias("found")))
    return df.withColumns({n: spans(n) for n in patterns}).drop(*(f"_{c}_{n}" for n in patterns for c in ("found", "gaps", "n", "end")))


def span(start: Column, kind: int | Column, end: Column) -> Column:
    """Spans in this form sort by start, then kind."""
    return F.struct(start.alias("start"), (F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), end.alias("end"))


def apart(df: DataFrame) -> DataFrame:
    """df with those of its candidates that overlap none of its base spans."""
    far = F.lit((1 << 31) - 1)
    both = F.array_sort(F.concat(F.transform("base", lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("other"), b["end"].alias("end"), F.lit("").alias("found"))), F.transform("candidates", lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("other"), c["end"].alias("end"), c["found"].alias("found")))))
    needed = (F.size("base") > 0) & (F.size("candidates") > 0)
    df = df.withColumn("_both", F.when(needed, both).otherwise(F.slice(both, 1, 0)))
    ends = F.transform("_both", lambda x: F.when(x["other"] == 0, x["end"]).otherwise(0))
    starts = F.transform(F.reverse("_both"), lambda x: F.when(x["other"] == 0, far - x["start"]).otherwise(0))
    df = running(df.withColumns({"_ends": ends, "_starts": starts}), {"_before": ("_ends", F.greatest), "_after": ("_starts", F.greatest)})
    told = F.zip_with(F.zip_with("_both", "_before", lambda x, e: F.struct(x.alias("x"), e.alias("before"))), F.reverse("_after"), lambda y, a: F.struct(y["x"].alias("x"), y["before"].alias("before"), (far - a).alias("after")))
    clear = F.filter(told, lambda y: (y["x"]["other"] == 1) & (y["before"] <= y["x"]["start"]) & (y["after"] >= y["x"]["end"]))
    kept = F.transform(clear, lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["found"].alias("found")))
    return df.withColumn("candidates", F.when(needed, kept).otherwise(F.col("candidates"))).drop("_both", "_ends", "_starts", "_before", "_after")


def scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """uid, key, base spans and candidates of every row."""
    found = spread(docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t")))
    found = located(found, "t", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "candidates": CANDIDATE})
    long_enough = lambda x: F.char_length(F.regexp_extract(x["found"], ASSIGN, 2)) >= LEAST_VALUE
    as_span = lambda kind: lambda x: span(x["start"], kind, x["end"])
    assign = F.transform(F.filter("assign", long_enough), as_span(0))
    base = F.array_sort(F.concat(assign, F.transform("access", as_span(1)), F.transform("hex", as_span(2))))
    mixed = lambda x: x["found"].rlike("[0-9]") & x["found"].rlike("[A-Za-z]")
    out = found.select(F.monotonically_increasing_id().alias("uid"), key, base.alias("base"), F.filter("candidates", mixed).alias("candidates"))
    return apart(out)


def above(z: Column) -> Column:
    """The chance that a standard normal number exceeds z (logistic approximation)."""
    return F.lit(1.0) / (1.0 + F.exp(1.5976 * z + 0.07056 * z * z * z))


def tested(candidates: DataFrame) -> DataFrame:
    """Adds encoding, length class and bin of the chance under the null hypothesis to uid, start, end, found."""
    plain = F.when(F.col("found").rlike("^[0-9A-F]+$"), F.lower("found")).otherwise(F.translate(F.rtrim(F.col("found"), F.lit("=")), "-_=", "+/"))
    df = candidates.withColumn("code", plain)
    encoding = F.when(F.col("code").rlike("^[0-9a-f]*$"), "hex").when(F.col("code").rlike("^[A-Z2-7]*$"), "b32").otherwise("b64")
    df = df.withColumn("encoding", encoding).withColumn("n", F.greatest(F.char_length("code"), F.lit(2)).cast("double"))
    by_encoding = lambda f: F.when(F.col("encoding") == "hex", f("hex")).when(F.col("encoding") == "b32", f("b32")).otherwise(f("b64"))
    of = lambda f: by_encoding(lambda e: f(ALPHABETS[e]))
    n, free, uneven, changes = F.col("n"), of(lambda a: F.lit(len(a) - 1.0)), by_encoding(lambda e: F.lit(ORDINARY[e][0])), by_encoding(lambda e: F.lit(ORDINARY[e][1]))
    # chi-squared: the counts of all symbols, squared and summed; for ordinary strings it grows with the length
    squares = of(lambda a: sum((F.pow(n - F.char_length(F.replace("code", F.lit(c), F.lit(""))), F.lit(2)) for c in a), F.lit(0.0)))
    chi = (free + 1) / n * squares - n
    even = above((free + n * uneven - chi) / F.sqrt(2 * free + 4 * n * uneven))
    # runs of one class: capitals, small letters, digits, others
    changed = F.char_length(F.regexp_replace(F.regexp_replace(F.regexp_replace("code", "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "0")).cast("double") - 1
    restless = above((changed - (n - 1) * changes) / F.sqrt((n - 1) * changes * (1 - changes)))
    # serial correlation of symbol numbers with their neighbours'
    numbers = of(lambda a: F.transform(F.filter(F.split("code", ""), lambda c: c != ""), lambda c: F.position(c, F.lit(a)).cast("double") - 1))
    df = df.withColumn("even", even).withColumn("restless", restless).withColumn("v", F.filter(numbers, lambda x: x >= 0))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("mean", total(F.col("v")) / n).withColumn("d", F.transform("v", lambda x: x - F.col("mean")))
    df = df.withColumn("var", total(F.transform("d", lambda x: x * x)))
    near = total(F.zip_with(F.slice("d", F.lit(1), F.greatest(F.size("d") - 1, F.lit(0))), F.slice("d", F.lit(2), F.greatest(F.size("d") - 1, F.lit(0))), lambda x, y: x * y))
    off = F.when(F.col("var") > 0, F.abs(near / F.col("var") + 1 / n)).otherwise(1.0)
    loose = above((SERIAL - off) * F.sqrt(n / (1 - SERIAL * SERIAL)))
    middle = F.get(F.array_sort(F.array("even", "restless", loose)), F.lit(1))
    chance = F.least(F.lit(1.0), 2 * middle)
    length = F.floor(F.log2("n") * 2).cast("int")
    return df.select("uid", "start", "end", "encoding", length.alias("length"), F.least(F.floor(-F.log10(F.greatest(chance, F.lit(1e-40))) * BINS_A_DECADE), F.lit(LAST_BIN)).cast("int").alias("bin"))


def first_random_bin(judged: DataFrame, false: float = FALSE) -> DataFrame:
    """encoding, length, cut: from this bin on a class's strings are reported; classes without a report are left out. A bin counts with its greatest chance."""
    counts = judged.groupBy("encoding", "length", "bin").agg(F.count("*").alias("k"))
    of = Window.partitionBy("encoding", "length")
    rank = F.sum("k").over(of.orderBy(F.desc("bin")))
    chance = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE)
    ranked = counts.withColumn("rank", rank).withColumn("m", F.sum("k").over(of))
    return ranked.where(chance * F.col("m") <= false * F.col("rank")).groupBy("encoding", "length").agg(F.min("bin").alias("cut"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", false: float = FALSE) -> DataFrame:
    """key, base and spans, both arrays of (start, kind, end) by start and kind; kind counts in KINDS."""
    rows = stored(scanned(docs, key, text), "secrets")
    judged = stored(tested(rows.select("uid", F.explode("candidates").alias("c")).select("uid", "c.start", "c.end", "c.found")), "secrets-tested")
    # three encodings, a class for each half power of two of the length: a hundred rows or so
    cut = F.broadcast(first_random_bin(judged, false))
    random = judged.join(cut, ["encoding", "length"]).where("bin >= cut")
    more = random.groupBy("uid").agg(F.collect_list(span(F.col("start"), 3, F.col("end"))).alias("more"))
    joined = rows.join(more, "uid", "left").withColumn("more", F.coalesce("more", F.slice("base", 1, 0)))
    return joined.select(key, "base", F.array_sort(F.concat("base", "more")).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs, key, text).select(key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span of every text replaced by a mark. Rows are told apart by a number of their own, so keys may be null or repeat; columns may have any names, as they have none of theirs inside."""
    names, whole = docs.columns, f"c{docs.columns.index(text)}"
    docs = stored(docs.toDF(*(f"c{i}" for i in range(len(names)))).withColumn("_row", F.monotonically_increasing_id()), "secrets-rows")
    found = scan(docs, "_row", whole).where(F.size("spans") > 0).select("_row", F.col("spans").alias("_spans"))
    found = running(found.withColumn("_ends", F.transform("_spans", lambda s: s["end"])), {"_reach": ("_ends", F.greatest)})
    # from where on each span's text before it is kept: the furthest end of the spans before
    at = F.zip_with("_spans", F.slice(F.concat(F.array(F.lit(0)), "_reach"), F.lit(1), F.size("_spans")), lambda s, a: F.struct(a.alias("at"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select("_row", F.filter(at, lambda s: s["end"] > s["at"]).alias("_cuts"), F.array_max("_reach").alias("_rest"))
    found = found.hint("merge")  # the same plan at every size: texts with secrets grow with the table
    joined = docs.join(found, "_row", "left")
    # pieces are taken from blocks of the text, since counting characters from its start for each would be their square
    piece = lambda whole, first: lambda s: whole.substr(s["at"] - first + 1, F.greatest(s["start"] - s["at"], F.lit(0)))
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_cuts") - 1, F.lit(0)), F.lit(CHUNK)), lambda i: F.slice("_cuts", i + 1, CHUNK))
    blocks = F.transform(chunks, lambda c: F.struct(c.alias("cuts"), c[0]["at"].alias("at"), F.col(whole).substr(c[0]["at"] + 1, F.element_at(c, -1)["end"] - c[0]["at"]).alias("block")))
    joined = joined.withColumn("_blocks", F.when(F.size("_cuts") > 0, blocks))
    kept = F.flatten(F.transform("_blocks", lambda b: F.transform(b["cuts"], piece(b["block"], b["at"]))))
    new = F.concat(F.array_join(kept, mark), F.lit(mark), F.col(whole).substr(F.col("_rest") + 1, F.char_length(whole)))
    out = joined.withColumn(whole, F.when(F.col("_blocks").isNotNull(), new).otherwise(F.col(whole)))
    return out.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)
