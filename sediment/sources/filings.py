"""Readers of filing indexes and submissions that have been downloaded, and of factor and bar files."""

from __future__ import annotations

import gzip
import io
import zipfile
import zlib
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.tables import stored

COLUMNS = ["accessionNumber", "filingDate", "acceptanceDateTime", "form", "primaryDocument", "items"]
FLAT = ", ".join(f"{c}: array<string>" for c in COLUMNS)
SUBMISSIONS = f"filings struct<recent: struct<{FLAT}>, files: array<struct<name: string, filingFrom: string, filingTo: string>>>, " + ", ".join(f"{c} array<string>" for c in COLUMNS)


def latest_success(requests: DataFrame) -> DataFrame:
    """The last request of each URL that succeeded (status 200-299, with a hash)."""
    ok = requests.where(F.col("status").between(200, 299) & F.col("content_hash").isNotNull())
    w = Window.partitionBy("url").orderBy(F.desc("request_id"))
    return ok.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def content_changes(requests: DataFrame) -> DataFrame:
    """Successful requests with content_changed: the hash differs from the URL's success before (null for the first)."""
    ok = requests.where(F.col("status").between(200, 299) & F.col("content_hash").isNotNull())
    before = F.lag("content_hash").over(Window.partitionBy("url").orderBy("request_id"))
    return ok.withColumn("content_changed", F.when(before.isNotNull(), before != F.col("content_hash")))


def decoded_body():
    """A function of (body, encoding) columns: bodies as sent, with gzip or deflate undone."""

    def one(body, encoding):
        if body is None:
            return None
        e = (encoding or "").lower()
        if e == "gzip":
            return gzip.decompress(body)
        if e == "deflate":
            try:
                return zlib.decompress(body)
            except zlib.error:
                return zlib.decompress(body, -zlib.MAX_WBITS)
        return body

    @F.pandas_udf("binary")
    def run(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([one(b, e) for b, e in zip(bodies, encodings)])

    return run


def encoded_body():
    """A function of (body, encoding) columns: bodies as a server sends them, with gzip or deflate."""

    def one(body, encoding):
        e = (encoding or "").lower()
        return body if body is None else gzip.compress(body, mtime=0) if e == "gzip" else zlib.compress(body) if e == "deflate" else body

    @F.pandas_udf("binary")
    def run(bodies: pd.Series, encodings: pd.Series) -> pd.Series:
        return pd.Series([one(b, e) for b, e in zip(bodies, encodings)])

    return run


def normalized_cik(cik: Column) -> Column:
    """Ten digits with leading zeros; anything but up to ten digits is an error."""
    bare = F.btrim(cik.cast("string"))
    return F.when(bare.rlike(r"^\d{1,10}$"), F.lpad(bare, 10, "0")).when(cik.isNotNull(), F.raise_error(F.concat(F.lit("no CIK: "), bare)))


def submission_filings(df: DataFrame, payload: str, cik: str, start: str, end: str, forms: list[str]) -> DataFrame:
    """Columnar filing JSON (recent or flat shape) to one row a filing in the date range and forms.

    acceptance_at is null where blank; is_amendment: the form ends in /A. Sort by (acceptance or midnight UTC of the filing
    date, accession) where an order is needed: sort_at has it. Required columns that are missing or unequally long, dates
    that are none and a range that ends before it starts are errors; acceptances and items may be short or missing.
    """
    given = df.where(F.col(payload).isNotNull()).select(normalized_cik(F.col(cik)).alias("cik"), parsed_submission(F.col(payload)).alias("p"))
    return listed_filings(given, start, end, forms)


def parsed_submission(payload: Column) -> Column:
    """Filing JSON of either shape as a struct. Give it a column of its own: each mention of it would parse the text again."""
    return F.from_json(payload, SUBMISSIONS)


def listed_filings(given: DataFrame, start: str, end: str, forms: list[str]) -> DataFrame:
    """submission_filings of given (cik, p: the parsed payload)."""
    if end < start:
        raise ValueError("end date must not precede start date")
    p = F.col("p")
    got = lambda c: F.when(p["filings"].isNotNull(), p["filings"]["recent"][c]).otherwise(p[c])
    required = [got(c) for c in ("accessionNumber", "filingDate", "form", "primaryDocument")]
    equal = F.size(required[0]) == F.size(required[1])
    for c in required[2:]:
        equal &= F.size(c) == F.size(required[0])
    n = F.when(F.coalesce(equal & required[0].isNotNull(), F.lit(False)), F.size(required[0])).otherwise(F.raise_error(F.lit("filing columns are missing or unequally long")).cast("int"))
    zipped = F.slice(F.arrays_zip(*[F.coalesce(got(c), F.array().cast("array<string>")).alias(c) for c in COLUMNS]), F.lit(1), n)
    rows = given.select("cik", F.explode(zipped).alias("f"))
    f = lambda c: F.nullif(F.trim(F.col("f")[c]), F.lit(""))
    day = F.try_to_date(f("filingDate"))
    out = rows.select(
        f("accessionNumber").alias("accession_number"), "cik", F.when(day.isNotNull(), day).otherwise(F.raise_error(F.lit("no filing date")).cast("date")).alias("filing_date"), F.try_to_timestamp(f("acceptanceDateTime")).alias("acceptance_at"),
        f("form").alias("form"), f("primaryDocument").alias("primary_document"),
        F.filter(F.transform(F.split(F.coalesce(F.col("f")["items"], F.lit("")), ","), lambda i: F.trim(i)), lambda i: i != "").alias("items"),
    )
    out = out.where(F.col("filing_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("form").isin(forms))
    midnight = F.timestamp_seconds(F.unix_date("filing_date").cast("long") * 86400)
    return out.withColumn("is_amendment", F.endswith("form", F.lit("/A"))).withColumn("sort_at", F.coalesce("acceptance_at", midnight))


def history_files(df: DataFrame, payload: str, start: str, end: str) -> DataFrame:
    """Names of history files whose closed date interval meets [start, end]."""
    files = df.select(F.explode(F.from_json(F.col(payload), SUBMISSIONS)["filings"]["files"]).alias("f")).select("f.*")
    return files.where((F.col("filingFrom") <= end) & (F.col("filingTo") >= start))


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """Union in order of priority: of rows with the same key the first frame's stays."""
    both = None
    for i, f in enumerate(frames):
        f = f.withColumn("_p", F.lit(i))
        both = f if both is None else both.unionByName(f)
    w = Window.partitionBy(key).orderBy("_p")
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_p")


def sgml_tag(block: Column, name: str) -> Column:
    """What follows a tag up to the end of its line or the next one, read as UTF-8, from a block of one character a byte."""
    value = F.encode(F.regexp_extract(block, rf"(?i)<{name}>\s*([^\r\n<]*)", 1), "ISO-8859-1")
    return F.nullif(F.btrim(F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")), F.lit(""))


def submission_documents(df: DataFrame, raw: str, key: str) -> DataFrame:
    """Complete submissions (BINARY) to one row a <DOCUMENT> block: its order, tags and byte-exact hash.

    Bytes are read as Latin-1, one character a byte, so the blocks' bytes come back unchanged."""
    text = F.decode(F.col(raw), "ISO-8859-1")
    blocks = F.regexp_extract_all(text, F.lit(r"(?is)<DOCUMENT\s*>.*?</DOCUMENT\s*>"), F.lit(0))
    rows = df.select(F.col(key), F.posexplode(blocks).alias("position", "block"))
    tags = [sgml_tag(F.col("block"), t).alias(t.lower()) for t in ("TYPE", "SEQUENCE", "FILENAME", "DESCRIPTION")]
    return rows.select(key, "position", *tags, F.sha2(F.encode("block", "ISO-8859-1"), 256).alias("content_hash"))


def factor_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Daily factor CSV lines to (session_date, mkt, smb, hml, rf): rows of an 8-digit date and four per cent values."""
    cells = F.transform(F.split(line, ","), lambda c: F.trim(c))
    rows = lines.select(cells.alias("c")).where(F.get("c", F.lit(0)).rlike(r"^\d{8}$") & (F.size("c") >= 5))
    return rows.select(F.to_date(F.get("c", F.lit(0)), "yyyyMMdd").alias("session_date"), *[(F.get("c", F.lit(i)).cast("double") / 100.0).alias(n) for i, n in enumerate(("mkt", "smb", "hml", "rf"), 1)])


def zipped_csv_lines():
    """A function of a BINARY column: lines of the one .csv member of each archive; none or several are an error."""

    def one(raw):
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".csv")]
            if len(names) != 1:
                raise ValueError(f"expected one .csv member, found {len(names)}")
            return z.read(names[0]).decode("utf-8", "replace").splitlines()

    @F.pandas_udf("array<string>")
    def run(archives: pd.Series) -> pd.Series:
        return archives.map(one)

    return run


def paged_bars(pages: DataFrame, payload: str = "value") -> DataFrame:
    """Pages of {"bars": {symbol: [{t, o, h, l, c, v}]}} to one row a bar."""
    p = F.from_json(F.col(payload), "bars map<string, array<struct<t: string, o: double, h: double, l: double, c: double, v: bigint>>>")
    rows = pages.select(F.explode(p["bars"]).alias("symbol", "b")).select("symbol", F.explode("b").alias("b"))
    return rows.select("symbol", F.to_timestamp("b.t").alias("ts"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"))


def corporate_actions(pages: DataFrame, payload: str = "value") -> DataFrame:
    """Pages of {"corporate_actions": {group: [...]}} to (action_id, action_type, symbol, effective_date).

    The group loses one trailing s; symbol and date are the first present of their alternatives; rows lacking one drop.
    """
    p = F.from_json(F.col(payload), "corporate_actions map<string, array<map<string, string>>>")
    rows = pages.select(F.explode(p["corporate_actions"]).alias("g", "a")).select("g", F.explode("a").alias("a"))
    pick = lambda *names: F.coalesce(*[F.try_element_at("a", F.lit(n)) for n in names])
    out = rows.select(
        pick("id").alias("action_id"), F.regexp_replace("g", "s$", "").alias("action_type"), pick("symbol", "old_symbol", "acquiree_symbol").alias("symbol"),
        F.try_to_date(pick("ex_date", "effective_date", "process_date", "payable_date")).alias("effective_date"),
    )
    return out.dropna(subset=["symbol", "effective_date"])


def company_names(requests: DataFrame) -> DataFrame:
    """The last non-blank name in each CIK's submissions JSON."""
    cik = F.regexp_extract("url", r"CIK(\d{10})\.json$", 1)
    name = F.nullif(F.trim(F.get_json_object("body", "$.name")), F.lit(""))
    return requests.select(cik.alias("cik"), name.alias("name"), "request_id").where("cik != '' and name is not null").groupBy("cik").agg(F.max_by("name", "request_id").alias("name"))


def eligible(docs: DataFrame) -> DataFrame:
    """Text files of a primary filing type or an exhibit."""
    suffix = F.lower(F.regexp_extract(F.coalesce("filename", "path"), r"(\.[^./]+)$", 1))
    kind = F.upper("document_type")
    return docs.where(suffix.isin(".htm", ".html", ".txt") & (kind.isin("8-K", "8-K/A", "10-Q", "10-Q/A") | kind.startswith("EX-")))


def archive_url(cik: Column, accession: Column, base: str = "https://archive.example") -> Column:
    return F.concat(F.lit(f"{base}/"), cik.cast("bigint").cast("string"), F.lit("/"), F.regexp_replace(accession, "-", ""))


def content_path(raw: bytes, suffix: str, root: str = "sec") -> str:
    h = sha256(raw).hexdigest()
    return f"{root}/{h[:2]}/{h}{suffix}"


def collect_companies(requests: DataFrame, bodies: DataFrame, companies: DataFrame, start: str, end: str, forms: list[str], base: str = "https://data.example", archive: str = "https://archive.example") -> dict[str, DataFrame]:
    """Walks downloaded files from companies (cik) to their filings' documents.

    requests: request_id, url, status, content_hash; bodies: content_hash, body (BINARY). Of each URL the latest success
    counts. A company's index names its recent filings and its history files; only history files whose dates meet the range
    are read, in a second scan, and filings of the index win over theirs. Each filing has a primary document, a complete
    submission and an index page; complete submissions are split into documents.

    Returns filings (with found_in), sources (cik, accession_number, role, url, request_id, content_hash; the last two null
    where nothing was downloaded: also of a company's index and of history files) and documents. Bodies are joined by
    hash, one file's body to a task's row at a time; nothing is kept for one company.
    """
    good = latest_success(requests).select("url", "request_id", "content_hash")
    wanted = companies.select(normalized_cik(F.col("cik")).alias("cik")).distinct()
    index = wanted.select("cik", F.lit(None).cast("string").alias("accession_number"), F.lit("submissions").alias("role"), F.concat(F.lit(f"{base}/submissions/CIK"), "cik", F.lit(".json")).alias("url"))
    index = stored(index.join(good, "url", "left"), "collect-index")
    body = F.decode("body", "UTF-8")
    read = lambda files: files.join(bodies, "content_hash").where(F.col("body").isNotNull()).select("cik", parsed_submission(body).alias("p"))
    first = stored(read(index), "collect-payloads")
    named = first.select("cik", F.explode("p.filings.files").alias("f")).select("cik", "f.*").where((F.col("filingFrom") <= end) & (F.col("filingTo") >= start))
    history = named.select("cik", F.lit(None).cast("string").alias("accession_number"), F.lit("historical_submissions").alias("role"), F.concat(F.lit(f"{base}/submissions/"), "name").alias("url")).distinct()
    history = stored(history.join(good, "url", "left"), "collect-history")
    both = [listed_filings(given, start, end, forms).withColumn("found_in", F.lit(role)) for given, role in ((first, "submissions"), (read(history), "historical_submissions"))]
    once = [f.dropDuplicates(["cik", "accession_number"]) for f in both]
    filings = stored(once[0].unionByName(once[1].join(once[0].select("cik", "accession_number"), ["cik", "accession_number"], "left_anti")), "collect-filings")
    folder = archive_url(F.col("cik"), F.col("accession_number"), archive)
    part = lambda role, name: F.struct(F.lit(role).alias("role"), F.concat(folder, F.lit("/"), name).alias("url"))
    parts = F.array(part("primary_document", F.col("primary_document")), part("complete_submission", F.concat("accession_number", F.lit(".txt"))), part("filing_index", F.concat("accession_number", F.lit("-index.html"))))
    pages = filings.select("cik", "accession_number", F.explode(parts).alias("p")).select("cik", "accession_number", "p.*")
    pages = stored(pages.join(good, "url", "left"), "collect-pages")
    cols = ["cik", "accession_number", "role", "url", "request_id", "content_hash"]
    sources = index.select(*cols).unionByName(history.select(*cols)).unionByName(pages.select(*cols))
    complete = pages.where("role = 'complete_submission'").join(bodies, "content_hash").select(F.struct("cik", "accession_number").alias("filing"), "body")
    documents = submission_documents(complete, "body", "filing").select("filing.*", "position", "type", "sequence", "filename", "description", F.col("content_hash"))
    return {"filings": filings, "sources": sources, "documents": documents}
