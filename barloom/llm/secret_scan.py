"""Operator 5, secrets: patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame functions; no Python runs on the executors.

The base finds assignments of a secret, access keys and long hexadecimal runs by pattern. The method
adds ``random`` spans: runs of 20 or more key characters with letters and digits, wherever they stand (an
equals sign only ends a run; runs that mix alphabets are cut into parts that fit one; long alphanumeric
segments of a run with separators, such as a key in a path, are tried too). The encoding of a run is inferred
(hexadecimal, base 32, alphanumeric, base 64), and three tests ask how surprising the run's closeness to
randomness is *if it were an identifier or prose*, in which a fifth of the characters are digits:

* chi-squared of the characters' counts against a uniform alphabet. An identifier exceeds the uniform
  statistic by what ``coincidence`` says for its encoding; the p-value is that of one as near to its mean of
  random characters as the one seen, so that all characters equally often is no sign of randomness.
* runs of upper case, lower case, digits and signs, where a capital letter belongs to the small ones after
  it and a sign to what follows. In an identifier a run ends after ``1 / change`` characters; the p-value is
  that of a number of runs as near to the expected one of random characters.
* the serial correlation of neighbours' places in the alphabet, ``SERIAL`` in an identifier; the p-value is
  that of one as near to zero.

Fisher's method combines them into one p-value, so that no test is a gate of its own. False discoveries are
controlled by Benjamini and Hochberg's rule within each stratum of encoding and length, over the whole
corpus: p-values are counted in ``BINS`` bins of equal width in log10 (a bin counts with its upper end, so
the bound holds), which gives each stratum's threshold from a table of a fixed size, joined back by broadcast.

Null texts are empty. Repeated rows each get their spans. Ties: p-values that share a bin are discovered together; of spans with one
start the kind listed first comes first. Positions are code points, ends exclusive. A text of
any length is one row; places of its matches are summed in blocks of ``BLOCK``, so many matches take about
linear time. A ``random`` span may overlap a base span: the battery judges each run by itself. An empty
table gives no rows. Other columns, whatever their names, are not read. Ids may be of any type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.llm.common import let, table, written

#: The base patterns. Possessive runs find the same matches in linear time.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"(?<![A-Za-z0-9])[A-Za-z0-9+/]{20,}+={0,2}|(?<![A-Za-z0-9])[A-Za-z0-9_-]{20,}+={0,2}"
SEGMENT = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}+"

#: Encodings in the order in which they are tried: name, pattern of the whole run, alphabet.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("lower36", r"^[a-z0-9]+$", _LOWER + _DIGITS),
    ("upper36", r"^[A-Z0-9]+$", _UPPER + _DIGITS),
    ("alnum62", r"^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", r"^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", r"^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_"),
)
#: Shares of the letters in English, in percent, from a to z.
LETTER_SHARES = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
#: An identifier: the share of digits, of letters in its rarer case where there are two, ends of runs a step in one and in two cases, serial correlation.
DIGITS, RARER, CHANGES, SERIAL = 0.2, 0.1, (0.15, 0.25), 0.3
Q = 0.01
BINS = 400
BINS_PER_DECADE = 10
STRATA = (20, 24, 32, 40, 64, 128)
#: Matches whose lengths are summed at once.
BLOCK = 64


def _cases(alphabet: str) -> int:
    return any(c.isupper() for c in alphabet) + any(c.islower() for c in alphabet)


def coincidence(alphabet: str) -> float:
    """The chance that two characters of an identifier in this alphabet are equal."""
    digits = sum(c.isdigit() for c in alphabet)
    share = [LETTER_SHARES[i] for i in range(26) if chr(97 + i) in alphabet.lower()]
    letters = sum(x * x for x in share) / sum(share) ** 2
    rarer = RARER * (_cases(alphabet) - 1)
    return (1 - DIGITS - rarer) ** 2 * letters + rarer**2 * letters + DIGITS**2 / digits


def change(alphabet: str) -> float:
    """The chance that a run ends between two uniform characters of the alphabet."""
    upper, lower, digit = (sum(map(f, alphabet)) / len(alphabet) for f in (str.isupper, str.islower, str.isdigit))
    sign = 1 - upper - lower - digit
    return upper * (digit + sign) + lower * (1 - lower) + digit * (1 - digit)


def identifier_change(alphabet: str) -> float:
    return CHANGES[_cases(alphabet) - 1]


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """Structs ``s, e`` (and ``g``, a group's text) of the leftmost non-overlapping matches, which must not be empty.

    Splitting at the pattern gives what lies between its matches, so lengths add up to places.
    """
    found = lambda g: F.regexp_extract_all(text, F.lit(pattern if "(" in pattern.replace("(?", "") else f"({pattern})"), F.lit(g))
    value = F.struct(F.split(text, pattern, -1).alias("p"), found(0).alias("m"), (found(group) if group else F.array().cast("array<string>")).alias("g"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, n: acc + n)

    def placed(v: Column) -> Column:
        return let(F.zip_with(F.slice(v["p"], 1, F.size(v["m"])), v["m"], lambda p, m: F.length(p) + F.length(m)), lambda steps: offsets(v, steps))

    def offsets(v: Column, steps: Column) -> Column:
        """``at[b]`` is where the b-th block of matches starts."""
        blocks = F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(steps, b * BLOCK + 1, BLOCK)))
        at = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
        return let(at, lambda a: F.transform(v["m"], lambda m, i: one(v, steps, a, m, i)))

    def one(v: Column, steps: Column, at: Column, m: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        e = F.get(at, block) + total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK + 1))
        return F.struct((e - F.length(m)).alias("s"), e.alias("e"), (F.get(v["g"], i) if group else m).alias("g"))

    none = F.array().cast("array<struct<s:int,e:int,g:string>>")
    return F.when(text.rlike(pattern), let(value, placed)).otherwise(none)


def _kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def base(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays ``__assign, __access, __hex`` of structs ``s, k, e``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.withColumn("__assign", _kind(F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["g"]) >= 6), 0))
        .withColumn("__access", _kind(matches(text, ACCESS), 1))
        .withColumn("__hex", _kind(matches(text, HEX), 2))
    )


def _normal_cdf(z: Column) -> Column:
    """The normal distribution function, to 1e-7 of its value in the body; the lower tail by its asymptotic series."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / 2.5066282746310002 * poly
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _between(low: Column, high: Column) -> Column:
    """The normal probability of an interval, by the lower tails, which are exact to several digits."""
    return F.when(low > 0, _normal_cdf(-low) - _normal_cdf(-high)).otherwise(_normal_cdf(high) - _normal_cdf(low))


def battery(run: Column) -> Column:
    """A struct of the tests of a run of key characters: ``enc, n, p_chi, p_runs, p_serial, p``; null where no encoding fits."""
    enc = F.lit(None).cast("int")
    for i, (_, pattern, _) in reversed(list(enumerate(ENCODINGS))):
        enc = F.when(run.rlike(pattern), F.lit(i)).otherwise(enc)
    of = lambda f: F.array(*[F.lit(f(a)) for _, _, a in ENCODINGS])
    known = F.struct(run.alias("run"), enc.alias("enc"), F.get(of(str), enc).alias("alphabet"), F.get(of(coincidence), enc).alias("equal"), F.get(of(change), enc).alias("change"), F.get(of(identifier_change), enc).alias("mu"))

    def tested(v: Column) -> Column:
        k = F.length(v["alphabet"]).cast("double")
        places = F.transform(F.split(F.rtrim(v["run"], F.lit("=")), "(?<=.)(?=.)", -1), lambda c: F.instr(v["alphabet"], c) - 1)
        kind = lambda c: F.when(c.rlike("[0-9]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[a-z]"), 2).otherwise(3)
        kinds = F.transform(F.split(F.rtrim(v["run"], F.lit("=")), "(?<=.)(?=.)", -1), kind)
        mean = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, i: acc + i) / F.size(x)
        return let(F.struct(k.alias("k"), places.alias("x"), kinds.alias("kinds")), lambda u: let(mean(u["x"]), lambda middle: let(_tests(v, u, middle), _combined)))

    return let(known, lambda v: F.when(v["enc"].isNotNull(), tested(v)))


def _neighbours(a: Column, f) -> Column:  # noqa: ANN001
    """The sum of a function of each element and the one before."""
    rest = lambda at: F.slice(a, at, F.size(a) - 1)
    return F.aggregate(F.zip_with(rest(2), rest(1), f), F.lit(0.0), lambda acc, x: acc + x)


def _tests(v: Column, u: Column, middle: Column) -> Column:
    k, x = u["k"], u["x"]
    n = F.size(x).cast("double")
    each = F.aggregate(x, F.array_repeat(F.lit(0), F.length(v["alphabet"])), lambda acc, i: F.transform(acc, lambda c, j: F.when(j == i, c + 1).otherwise(c)))
    squares = F.aggregate(each, F.lit(0.0), lambda acc, c: acc + c * c)
    chi2 = squares * k / n - n
    # if it were an identifier: a non-central chi-squared, scaled to a central one of the same mean and spread
    df, excess = k - 1, n * (k * v["equal"] - 1)
    mean, var = df + excess, 2 * (df + 2 * excess)
    scale, eff = var / (2 * mean), 2 * mean * mean / var
    cube = lambda c: (F.pow(F.greatest(c, F.lit(1e-9)) / (scale * eff), F.lit(1 / 3)) - (1 - 2 / (9 * eff))) / F.sqrt(2 / (9 * eff))
    far = F.abs(chi2 - df)

    ends = lambda b, a: ((a != b) & (a != 3) & ~((a == 1) & (b == 2))).cast("double")
    changes = _neighbours(u["kinds"], ends)
    uniform, mu, sd = (n - 1) * v["change"], (n - 1) * v["mu"], F.sqrt((n - 1) * v["mu"] * (1 - v["mu"]))
    off = F.abs(changes - uniform) + 0.5

    spread = F.aggregate(x, F.lit(0.0), lambda acc, i: acc + (i - middle) * (i - middle))
    lagged = _neighbours(x, lambda b, c: (b - middle) * (c - middle))
    serial = F.when(spread <= 0, F.sqrt(n)).otherwise(F.abs(lagged / F.greatest(spread, F.lit(1e-9)) + 1 / n) * F.sqrt(n))
    shift = F.sqrt(n) * SERIAL
    return F.struct(
        v["enc"].alias("enc"), F.size(x).alias("n"), _between(cube(df - far), cube(df + far)).alias("p_chi"),
        _between((uniform - off - mu) / sd, (uniform + off - mu) / sd).alias("p_runs"),
        _between(-serial - shift, serial - shift).alias("p_serial"),
    )


def _combined(t: Column) -> Column:
    """Fisher's method: the p-value of a product of three."""
    logs = [F.log(F.least(F.lit(1.0), F.greatest(t[f"p_{name}"], F.lit(1e-90)))) for name in ("chi", "runs", "serial")]
    return let(-(logs[0] + logs[1] + logs[2]), lambda x: F.struct(t["enc"].alias("enc"), t["n"].alias("n"), t["p_chi"].alias("p_chi"), t["p_runs"].alias("p_runs"), t["p_serial"].alias("p_serial"), (F.exp(-x) * (1 + x + x * x / 2)).alias("p")))


def candidates(docs: DataFrame, text_col: str = "text") -> Column:
    """An array of structs ``s, e, t``: key-like runs of a text with both letters and digits, and their tests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = lambda r: F.transform(matches(r["g"], SEGMENT), lambda x: F.struct((r["s"] + x["s"]).alias("s"), (r["s"] + x["e"]).alias("e"), x["g"].alias("g")))
    both = lambda runs: F.concat(runs, F.flatten(F.transform(F.filter(runs, lambda r: r["g"].rlike("[+/_-]")), inner)))
    runs = F.filter(let(matches(text, CANDIDATE), both), lambda x: x["g"].rlike("[0-9]") & x["g"].rlike("[A-Za-z]"))
    tested = F.transform(runs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["g"]).alias("t")))
    return F.filter(tested, lambda x: x["t"].isNotNull())


def _stratum(n: Column) -> Column:
    out = F.lit(0)
    for s in STRATA:
        out = out + (n >= s).cast("int")
    return out


def _bin(p: Column) -> Column:
    """0 is the bin of the smallest p-values."""
    return F.greatest(F.lit(0), F.lit(BINS) - 1 - F.floor(-F.log10(F.greatest(p, F.lit(1e-90))) * BINS_PER_DECADE).cast("int"))


def thresholds(tested: DataFrame, q: float = Q) -> DataFrame:
    """``(enc, stratum, bin)``: the last bin whose runs are discoveries, from columns ``enc, n, p``; at most a row a stratum."""
    binned = tested.select("enc", _stratum(F.col("n")).alias("stratum"), _bin(F.col("p")).alias("bin"))
    counts = binned.groupBy("enc", "stratum", "bin").agg(F.count("*").alias("c"))
    whole = W.partitionBy("enc", "stratum")
    up_to = counts.withColumn("m", F.sum("c").over(whole)).withColumn("r", F.sum("c").over(whole.orderBy("bin")))
    upper = F.pow(F.lit(10.0), -(F.lit(BINS) - 1 - F.col("bin")) / BINS_PER_DECADE)
    return up_to.filter(upper <= q * F.col("r") / F.col("m")).groupBy("enc", "stratum").agg(F.max("bin").alias("bin"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: float = Q) -> DataFrame:
    """Per row: the id, counts, the base's digest and all spans; of a discovered run's segments only the run is told."""
    d = base(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    found = F.concat("__assign", "__access", "__hex")
    d = d.select("doc_id", F.array_sort(found).alias("base"), F.col("text"))
    d = d.select("doc_id", "base", candidates(d).alias("runs"))
    d = written(d)
    held = thresholds(d.select(F.explode("runs").alias("r")).select("r.t.enc", "r.t.n", "r.t.p"), q)
    limits = held.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "enc", "stratum"), "bin"))).alias("limits"))

    def discovered(r: Column) -> Column:
        limit = F.col("limits")[F.concat_ws(":", r["t"]["enc"], _stratum(r["t"]["n"]))]
        return F.coalesce(_bin(r["t"]["p"]) <= limit, F.lit(False))

    # one row of at most len(ENCODINGS) * (len(STRATA) + 1) entries
    d = d.join(F.broadcast(limits), F.lit(True), "left")
    within = lambda r, o: (o["s"] <= r["s"]) & (o["e"] >= r["e"]) & (o["e"] - o["s"] > r["e"] - r["s"])
    extra = let(F.filter(F.col("runs"), discovered), lambda held: F.filter(held, lambda r: ~F.exists(held, lambda o: within(r, o))))
    every = F.array_sort(F.concat("base", F.transform(extra, lambda r: F.struct(r["s"].alias("s"), F.lit(3).alias("k"), r["e"].alias("e")))))
    named = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", F.get(F.array(*[F.lit(k) for k in KINDS]), x["k"]), x["s"], x["e"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"), named(every).alias("spans"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
