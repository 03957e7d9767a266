"""Sources and sinks: CSV tables under a fixed schema, factor files, filings, statements as text, result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null, date, last4, number

#: Columns of the statement tables, their kinds, and which must be there.
TABLES = {
    "statements": ("statement_id:str* account_id:str* custodian:str* period_start:date* period_end:date* ending_value:float* beginning_value:float stated_deposits:float stated_withdrawals:float "
                   "stated_income:float stated_fees:float stated_pnl:float stated_return_pct:float source_file:str source_pages:str notes:str"),
    "flows": "account_id:str* date:date* amount:float* flow_type:str* description:str source_statement_id:str",
    "positions": "statement_id:str* account_id:str* as_of_date:date* identifier:str* description:str asset_class:str quantity:float price:float market_value:float* weight_pct:float",
    "accounts": "account_id:str label:str owner_type:str discretionary:str strategy:str benchmark:str notes:str",
}
#: Words before a printed amount, by field.
LABELS = {
    "beginning_value": ["beginning value", "opening balance", "beginning balance", "starting value", "previous value"],
    "ending_value": ["ending value", "closing balance", "ending balance", "account value", "current value"],
    "stated_deposits": ["deposits", "additions", "contributions"],
    "stated_withdrawals": ["withdrawals", "distributions", "subtractions"],
    "stated_income": ["dividends and interest", "income"],
    "stated_fees": ["fees", "advisory fee"],
}
MONEY = r"\(?-?\$?\s?[0-9][0-9,]*(?:\.[0-9]+)?\)?"


def fields(name: str) -> list[tuple[str, str, bool]]:
    return [(c.split(":")[0], c.split(":")[1].rstrip("*"), c.endswith("*")) for c in TABLES[name].split()]


def conform(raw: DataFrame, name: str) -> DataFrame:
    """Strings to the table's schema: blanks and what can't be read are null, absent optional columns are added."""
    have = {c.strip().lower(): c for c in raw.columns}
    lacking = [c for c, _, must in fields(name) if must and c not in have]
    if lacking:
        raise ValueError(f"{name}: columns missing: {', '.join(lacking)}")

    def one(c: str, kind: str) -> Column:
        if c not in have:
            return F.lit(None).cast({"str": "string", "float": "double", "date": "date"}[kind]).alias(c)
        text = blank_to_null(F.col(f"`{have[c]}`"))
        return {"str": text, "float": F.regexp_replace(text, r"[,$]", "").try_cast("double"), "date": F.try_to_date(text, "yyyy-MM-dd")}[kind].alias(c)

    return raw.select(*[one(c, kind) for c, kind, _ in fields(name)])


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV with a header, read as strings without inference."""
    return conform(spark.read.option("header", True).option("inferSchema", False).csv(path), name)


def load_dataset(spark: SparkSession, folder: str, names=("statements", "flows", "positions", "accounts")) -> dict[str, DataFrame]:
    """The tables of a folder; one that is absent is empty, but for the statements."""
    out = {}
    for name in names:
        try:
            out[name] = read_table(spark, f"{folder}/{name}.csv", name)
        except Exception as e:
            if name == "statements" or "PATH_NOT_FOUND" not in str(e):
                raise
            out[name] = spark.createDataFrame([], ", ".join(f"{c} {dict(str='string', float='double', date='date')[k]}" for c, k, _ in fields(name)))
    return out


def stage_holdings(raw: DataFrame, path: str) -> None:
    """Holdings once as Parquet by quarter, so later reads prune to the quarters they need."""
    raw.write.mode("overwrite").partitionBy("period").parquet(path)


def factor_rows(lines: DataFrame, freq: str, *names: str) -> DataFrame:
    """Rows of one block of a factor file from lines(value): months are six digits, years four; -99.99 and below is null; per cents become shares."""
    head = r"^\s*(\d{6})\s*," if freq == "M" else r"^\s*(\d{4})\s*,"
    rows = lines.where(F.col("value").rlike(head)).select(F.regexp_extract("value", head, 1).alias("k"), F.split("value", ",").alias("v"))
    cell = lambda i: F.trim(F.get("v", F.lit(i))).try_cast("double")
    key = F.last_day(F.to_date("k", "yyyyMM")).alias("month") if freq == "M" else F.col("k").cast("int").alias("year")
    return rows.select(key, *[F.when(cell(i + 1) > -99.0, cell(i + 1) / 100).alias(n) for i, n in enumerate(names)])


def assemble_factors(first: DataFrame, *others: DataFrame, on: str = "month") -> DataFrame:
    """One table of all factors; a column that stands twice is taken once; mkt is the excess market and the rate; wml is mom."""
    out = first
    for o in others:
        out = out.join(o.select(on, *[c for c in o.columns if c != on and c not in out.columns]), on, "full_outer")
    if "wml" in out.columns:
        out = out.withColumnRenamed("wml", "mom")
    return out.withColumn("mkt", F.col("mkt_rf") + F.col("rf")) if {"mkt_rf", "rf"} <= set(out.columns) else out


def benchmark(factors: DataFrame, spec: str) -> DataFrame:
    """(month, r) of a blend such as 60:US_MKT,40:DXUS_MKT; weights are brought to one."""
    parts = [p.split(":") if ":" in p else ("1", p) for p in spec.split(",")]
    total = sum(float(w) for w, _ in parts)
    return factors.select("month", sum((F.col(n.strip()) * (float(w) / total) for w, n in parts), F.lit(0.0)).alias("r"))


def compound_over(periods: DataFrame, series: DataFrame) -> DataFrame:
    """A monthly series compounded over each period; null if any of its months is missing. The months are few."""
    s = F.broadcast(series.select(F.col("month").alias("m"), F.col("r").alias("br")))  # a row for each month
    j = periods.join(s, F.col("m").between(F.col("period_start"), F.col("period_end")), "left").groupBy("statement_id", "period_start", "period_end").agg(F.count("br").alias("n"), (F.product(1 + F.col("br")) - 1).alias("bench_r"))
    want = F.round(F.months_between(F.date_add("period_end", 1), "period_start")).cast("long")
    return j.select("statement_id", F.when(F.col("n") == want, F.col("bench_r")).alias("bench_r"))


def read_infotables(spark: SparkSession, path: str) -> DataFrame:
    """Lines of holdings filings in XML, a file or a folder of them."""
    schema = "nameOfIssuer string, titleOfClass string, cusip string, value string, shrsOrPrnAmt struct<sshPrnamt: string>, putCall string"
    raw = spark.read.format("xml").option("rowTag", "infoTable").option("ignoreNamespace", True).schema(schema).load(path)
    return raw.select(F.upper(F.trim("cusip")).alias("cusip"), F.trim("nameOfIssuer").alias("name"), F.trim("titleOfClass").alias("cls"), number(F.col("value")).alias("value"), number(F.col("shrsOrPrnAmt.sshPrnamt")).alias("shares"), F.lower(F.coalesce(F.trim("putCall"), F.lit(""))).alias("putcall"))


def filings(index: DataFrame) -> DataFrame:
    """(cik, accession, filed, period) of original holdings filings from index(cik, doc) of JSON with parallel lists."""
    kind = "struct<accessionNumber: array<string>, filingDate: array<string>, reportDate: array<string>, form: array<string>>"
    rows = index.select("cik", F.from_json("doc", kind).alias("d")).select("cik", F.explode(F.arrays_zip("d.accessionNumber", "d.filingDate", "d.reportDate", "d.form")).alias("x"))
    return rows.where("x.form = '13F-HR'").select("cik", F.col("x.accessionNumber").alias("accession"), F.try_to_date("x.filingDate").alias("filed"), F.try_to_date("x.reportDate").alias("period"))


def company_facts(docs: DataFrame, tags: dict[str, list[str]], forms=("10-K", "10-Q", "20-F", "40-F", "10-K/A", "10-Q/A")) -> DataFrame:
    """Facts from docs(ticker, doc) of JSON: the first tag of each fact's list that a company has, its unit by USD, shares, any."""
    entry = "array<struct<start: string, end: string, filed: string, fy: double, fp: string, form: string, val: double>>"
    parsed = docs.select("ticker", F.from_json("doc", f"map<string, struct<units: map<string, {entry}>>>").alias("m"))
    order = F.explode(F.array(*[F.struct(F.lit(f).alias("fact"), F.lit(i).alias("place"), F.lit(t).alias("tag")) for f, ts in tags.items() for i, t in enumerate(ts)])).alias("o")
    rows = parsed.select("ticker", "m", order).select("ticker", "o.fact", "o.place", F.col("m")[F.col("o.tag")]["units"].alias("u")).where("u is not null")
    unit = F.coalesce(F.col("u")["USD"], F.col("u")["shares"], F.get(F.map_values("u"), F.lit(0)))
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("ticker", "fact").orderBy("place"))).where("k = 1")
    out = best.select("ticker", "fact", F.explode(unit).alias("x")).where(F.col("x.form").isin(*forms))
    return out.select("ticker", "fact", F.try_to_date("x.start").alias("start"), F.try_to_date("x.end").alias("end"), F.try_to_date("x.filed").alias("filed"), "x.fy", "x.fp", "x.form", F.col("x.val").alias("value")).dropDuplicates()


def extract_statement_fields(texts: DataFrame) -> DataFrame:
    """Period, account and labelled amounts from texts(doc, text); the first label of each field's list that is there."""
    found = lambda labels: F.coalesce(*[number(F.nullif(F.regexp_extract("text", rf"(?im)^\W*{w}\b[^\n\d$(-]*({MONEY})", 1), F.lit(""))) for w in labels])
    span = r"(?i)(?:period|from)\W*([A-Za-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})\s*(?:to|through|-|–)\s*([A-Za-z]+ \d{1,2}, \d{4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})"
    account = F.nullif(F.regexp_extract("text", r"(?i)account\s*(?:number|no\.?|#)?\W*([Xx*\d-]{4,})", 1), F.lit(""))
    return texts.select("doc", date(F.nullif(F.regexp_extract("text", span, 1), F.lit(""))).alias("period_start"), date(F.nullif(F.regexp_extract("text", span, 2), F.lit(""))).alias("period_end"), last4(account).alias("account_id"), *[found(w).alias(f) for f, w in LABELS.items()])


def lines_of(texts: DataFrame) -> DataFrame:
    return texts.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def extract_two_column(texts: DataFrame) -> DataFrame:
    """Opening and closing amounts under a header of the two words in either order: the total line, else the sum of lines."""
    rows = lines_of(texts)
    head = rows.where(F.lower("line").rlike(r"opening.*closing|closing.*opening")).groupBy("doc").agg(F.min("pos").alias("head"), F.min_by(F.lower("line").rlike("opening.*closing"), "pos").alias("straight"))
    got = rows.join(head, "doc").where("pos > head").withColumn("m", F.regexp_extract_all("line", F.lit(f"({MONEY})"), F.lit(1))).where("size(m) >= 2")
    a, b = number(F.element_at("m", -2)), number(F.element_at("m", -1))
    got = got.select("doc", F.lower("line").rlike(r"^\W*total").alias("total"), F.when(F.col("straight"), a).otherwise(b).alias("opening"), F.when(F.col("straight"), b).otherwise(a).alias("closing"))
    pick = lambda c: F.coalesce(F.max(F.when(F.col("total"), F.col(c))), F.sum(F.when(~F.col("total"), F.col(c)))).alias(c)
    return got.groupBy("doc").agg(pick("opening"), pick("closing"))


def extract_transfers(texts: DataFrame) -> DataFrame:
    """Dated cash movements from activity lines: trades and dividends are none; the sign is that of the words."""
    rows = lines_of(texts).withColumn("low", F.lower("line"))
    rows = rows.where(F.col("low").rlike(r"deposit|withdraw|transfer|wire|contribution|distribution|ach") & ~F.col("low").rlike(r"bought|sold|buy|sell|dividend|interest|reinvest|fee"))
    when = date(F.nullif(F.regexp_extract("line", r"^\s*(\d{1,2}/\d{1,2}/\d{2,4}|\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    size = F.abs(number(F.element_at(F.regexp_extract_all(F.regexp_replace("line", r"^\s*[\d/-]+", ""), F.lit(f"({MONEY})"), F.lit(1)), -1)))
    out = F.col("low").rlike(r"withdraw|distribution|transfer out|wire out|sent|to bank")
    return rows.select("doc", when.alias("date"), F.when(out, -size).otherwise(size).alias("amount"), F.when(out, "withdrawal").otherwise("deposit").alias("flow_type")).where("date is not null and amount is not null")


def assemble_statements(found: DataFrame, moved: DataFrame, least: int = 12) -> tuple[DataFrame, DataFrame]:
    """Statements and flows: dated movements are trusted where they match the printed totals within one unit, else the
    net total is one flow in mid-period. Periods that repeat are one; accounts need at least the given number of statements."""
    one = found.where("account_id is not null and period_end is not null and ending_value is not null").dropDuplicates(["account_id", "period_start", "period_end"])
    many = one.withColumn("n", F.count("*").over(Window.partitionBy("account_id"))).where(F.col("n") >= least).drop("n")
    sums = moved.groupBy("doc").agg(F.sum("amount").alias("net_dated"))
    net = F.coalesce("stated_deposits", F.lit(0.0)) - F.abs(F.coalesce("stated_withdrawals", F.lit(0.0)))
    judged = many.join(sums, "doc", "left").withColumn("net", net).withColumn("trusted", F.col("net_dated").isNotNull() & (F.abs(F.col("net_dated") - net) <= 1))
    dated = moved.join(judged.where("trusted").select("doc", "account_id"), "doc").select("account_id", "date", "amount", "flow_type")
    mid = judged.where("not trusted and net <> 0").select("account_id", F.date_add("period_start", (F.datediff("period_end", "period_start") / 2).cast("int")).alias("date"), F.col("net").alias("amount"), F.when(F.col("net") > 0, "deposit").otherwise("withdrawal").alias("flow_type"))
    return judged.withColumn("statement_id", F.concat_ws("-", "account_id", F.date_format("period_end", "yyyyMMdd"))).drop("net", "net_dated"), dated.unionByName(mid)


def infer_grid(dates: DataFrame, *key: str) -> DataFrame:
    """Months where the median gap of days is under 45, years above 300, else an error mark."""
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*key).orderBy("date")))
    mid = F.percentile("gap", F.lit(0.5))
    return dates.withColumn("gap", gap).where("gap is not null").groupBy(*key).agg(F.when(mid < 45, "M").when(mid > 300, "A").otherwise("error").alias("grid"))


def returns_to_statements(series: DataFrame, *key: str, notional: float = 1_000_000.0) -> DataFrame:
    """series(key, month, r) as a statement path: per cents are seen by any |r| above 1.5, value is chained from the notional."""
    pct = F.max(F.abs("r")).over(Window.partitionBy(*key)) > 1.5
    w = Window.partitionBy(*key).orderBy("month")
    r = F.when(pct, F.col("r") / 100).otherwise(F.col("r"))
    value = notional * F.product(1 + F.col("rr")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = series.withColumn("rr", r).withColumn("ending_value", value).withColumn("beginning_value", F.coalesce(F.lag("ending_value").over(w), F.lit(notional)))
    return out.select(*key, F.trunc("month", "month").alias("period_start"), F.col("month").alias("period_end"), "beginning_value", "ending_value")


def values_to_statements(values: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """values(key, date, value, flow) as statements and flows; the first value is the opening deposit."""
    w = Window.partitionBy(*key).orderBy("date")
    rows = values.withColumn("k", F.row_number().over(w)).withColumn("before", F.lag("value").over(w)).withColumn("last_date", F.lag("date").over(w))
    st = rows.where("k > 1").select(*key, F.date_add("last_date", 1).alias("period_start"), F.col("date").alias("period_end"), F.col("before").alias("beginning_value"), F.col("value").alias("ending_value"))
    flow = F.when(F.col("k") == 1, F.col("value")).otherwise(F.col("flow"))
    return st, rows.withColumn("amount", flow).where("amount is not null and amount <> 0").select(*key, "date", "amount", F.when(F.col("amount") > 0, "deposit").otherwise("withdrawal").alias("flow_type"))


def statement_returns(statements: DataFrame, *key: str) -> DataFrame:
    """Monthly returns from ending values, for records whose money moved only at the start."""
    w = Window.partitionBy(*key).orderBy("period_end")
    return statements.select(*key, F.last_day("period_end").alias("month"), (F.col("ending_value") / F.nullif(F.lag("ending_value").over(w), F.lit(0.0)) - 1).alias("r")).where("r is not null")


def write_tables(results: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """A folder for each result."""
    for name, df in results.items():
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{path}/{name}")


def manifest(df: DataFrame, date_column: str, *counted: str) -> DataFrame:
    """Rows, range of dates and numbers of distinct keys, in one row."""
    return df.agg(F.count("*").alias("n_rows"), F.min(date_column).alias("first"), F.max(date_column).alias("last"), *[F.countDistinct(c).alias(f"n_{c}") for c in counted])
