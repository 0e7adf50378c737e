"""Session state as rows: cookies and storage entries, filtered, composed, checked and listed.

Cookies: ``(session, name, value, domain, path, expires, http_only, secure, same_site)``.
Storage: ``(session, origin, kind, name, value)``. Conflicts are rows, not exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from .privacy import REDACTED

COOKIE_VALUES = ("value", "expires", "http_only", "secure", "same_site")


def _key_columns(cookies: DataFrame) -> DataFrame:
    """Cookies with name, domain and path in normal form."""
    return cookies.withColumns({"name": F.trim("name"), "domain": F.lower(F.regexp_replace(F.trim("domain"), r"^\.+|\.+$", "")), "path": F.coalesce(F.nullif(F.trim("path"), F.lit("")), F.lit("/"))})


def cookies_from_events(df: DataFrame, text: str = "cookie") -> DataFrame:
    """Cookies from JSON records: name, value and domain required, a positive expiry kept as an integer."""
    c = F.from_json(F.col(text), "name string, value string, domain string, path string, expires double, httpOnly boolean, secure boolean, sameSite string")
    rows = df.select(c.alias("c")).where("c.name is not null and c.value is not null and c.domain is not null")
    return rows.select("c.name", "c.value", "c.domain", F.coalesce("c.path", F.lit("/")).alias("path"), F.when(F.col("c.expires") > 0, F.col("c.expires").cast("bigint")).alias("expires"), F.coalesce("c.httpOnly", F.lit(False)).alias("http_only"), F.coalesce("c.secure", F.lit(False)).alias("secure"), F.col("c.sameSite").alias("same_site"))


def cookie_json(cookies: DataFrame) -> DataFrame:
    """Cookies as JSON records; absent expiry and same-site are left out."""
    return cookies.select(F.to_json(F.struct("name", "value", "domain", "path", "expires", F.col("http_only").alias("httpOnly"), "secure", F.col("same_site").alias("sameSite"))).alias("cookie"))


def dedupe_cookies(cookies: DataFrame, order: str) -> DataFrame:
    """The first cookie of each (name, domain, path); later ones are dropped without complaint."""
    keys = ["name", "domain", "path"]
    rest = [c for c in cookies.columns if c not in (*keys, order)]
    first = _key_columns(cookies).groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__c"))
    return first.select(*(F.col(c) if c in keys else F.col(f"__c.{c}").alias(c) for c in cookies.columns))


def filter_cookies(cookies: DataFrame, allowed: list[str]) -> DataFrame:
    """Cookies whose domain an allowed domain covers."""
    test = F.lit(False)
    for domain in allowed:
        test = test | U.domain_covers(F.lit(domain), F.col("domain"))
    return cookies.where(test)


def filter_storage(storage: DataFrame, allowed: list[str]) -> DataFrame:
    test = F.lit(False)
    for domain in allowed:
        test = test | U.domain_covers(F.lit(domain), U.origin_host(F.col("origin")))
    return storage.where(test)


def _merge(rows: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(merged rows, conflicts): equal duplicates become one, differing ones are a conflict."""
    content = F.struct(*values)
    grouped = rows.groupBy(*keys).agg(F.min(content).alias("__a"), F.max(content).alias("__b"), F.min("session").alias("__first"), F.max("session").alias("__last"))
    differs = ~F.col("__a").eqNullSafe(F.col("__b"))
    merged = grouped.where(~differs).select(*keys, *(F.col(f"__a.{v}").alias(v) for v in values), F.when(F.col("__first") == F.col("__last"), F.col("__first")).alias("source_session"))
    return merged, grouped.where(differs).select(*keys, F.lit("session_conflict").alias("code"))


def compose_cookies(cookies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cookies of several sessions as one set, and the conflicts. Min and max of the values decide, so groups are never collected."""
    return _merge(_key_columns(cookies), ["name", "domain", "path"], list(COOKIE_VALUES))


def compose_storage(storage: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _merge(storage, ["origin", "kind", "name"], ["value"])


def compose_header(sessions: DataFrame) -> DataFrame:
    """One row: sorted names, the union of allowed domains, sensitive if any is."""
    domains = sessions.select(F.explode_outer("allowed_domains").alias("d")).agg(F.array_sort(F.collect_set("d")).alias("allowed_domains"))
    head = sessions.agg(F.array_sort(F.collect_set("name")).alias("sources"), F.coalesce(F.bool_or("sensitive"), F.lit(False)).alias("sensitive"))
    return head.crossJoin(domains)  # one row each


def login_export(cookies: DataFrame, storage: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cookies, storage, error) of a finished login: what the allowed domains cover; one error row if nothing is left."""
    c, s = filter_cookies(cookies, allowed), filter_storage(storage, allowed)
    found = c.agg(F.count("*").alias("n")).unionByName(s.agg(F.count("*").alias("n")))
    error = found.agg(F.sum("n").alias("n")).where("n = 0").select(F.lit("login_empty").alias("code"), F.lit("the login left no state on the allowed domains").alias("message"))
    return c, s, error


def login_merge_storage(old: DataFrame, fresh: DataFrame, fresh_domains: list[str]) -> DataFrame:
    """Storage entries after a login: those of origins on the fresh domains are replaced."""
    test = F.lit(False)
    for domain in fresh_domains:
        test = test | U.domain_covers(F.lit(domain), U.origin_host(F.col("origin")))
    return old.where(~test).unionByName(fresh)


def login_merge(old: DataFrame, fresh: DataFrame, fresh_domains: list[str]) -> DataFrame:
    """Cookies after a login: those of the fresh domains are replaced."""
    test = F.lit(False)
    for domain in fresh_domains:
        test = test | U.domain_covers(F.lit(domain), F.col("domain"))
    return old.where(~test).unionByName(fresh)


def _suffixes(host: Column) -> Column:
    """The host and the domains above it: all domains that cover it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def _clean_domain(domain: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(domain), r"^\.+|\.+$", ""))


def replay_scope(requests: DataFrame, cookies: DataFrame, url: str = "url", session: str = "session", storage: DataFrame | None = None) -> DataFrame:
    """Requests with ``scope_error``: a target that is no URL, state outside the target's scope, or none that matches.

    A request without a session passes. Cookies are counted per session and domain, and
    each distinct pair of session and host looks its few covering domains up, so the
    requests of a session never meet all of its cookies. Entries of ``storage`` count with
    the host of their origin, which must be the target's own.
    """
    host = U.host(F.col(url))
    domains = cookies.select(session, "domain")
    if storage is not None:
        # a leading mark keeps an origin from covering the hosts below it
        domains = domains.unionByName(storage.select(session, F.concat(F.lit("="), F.coalesce(U.origin_host(F.col("origin")), F.lit(""))).alias("domain")))
    state = domains.groupBy(F.col(session).alias("__s"), _clean_domain(F.col("domain")).alias("__d")).agg(F.count("*").alias("__n"))
    totals = state.groupBy("__s").agg(F.sum("__n").alias("__total"))
    pairs = requests.select(F.col(session).alias("__s"), host.alias("__h")).where("__s is not null and __h is not null").distinct()
    covered = pairs.withColumn("__d", F.explode(F.array_append(_suffixes(F.col("__h")), F.concat(F.lit("="), F.col("__h"))))).join(state, ["__s", "__d"]).groupBy("__s", "__h").agg(F.sum("__n").alias("__ok"))
    found = pairs.join(totals, "__s", "left").join(covered, ["__s", "__h"], "left").select(F.col("__s").alias(session), F.col("__h"), "__total", "__ok")
    out = requests.withColumn("__h", host).join(found, [session, "__h"], "left")
    total, ok = F.coalesce("__total", F.lit(0)), F.coalesce("__ok", F.lit(0))
    error = F.when(F.col(session).isNull(), None).when(F.col("__h").isNull(), "usage_error").when((total == 0) | (ok < total), "session_scope_mismatch")
    return out.withColumn("scope_error", error).select(*requests.columns, "scope_error")


def cookie_header(requests: DataFrame, cookies: DataFrame, url: str = "url", session: str = "session", position: str | None = None) -> DataFrame:
    """``cookie_header`` of each request: cookies that scheme, domain and path admit, null if there are none.

    Cookies come in the order of ``position``, the column that holds their stored place;
    without it in the order of domain, path and name.
    Requests look up the domains that cover their host; a header holds the cookies of these only.
    """
    c = cookies.select(F.col(session).alias("__s"), _clean_domain(F.col("domain")).alias("__d"), *(F.col(x).alias(f"__{x}") for x in ("name", "value", "path", "secure")), (F.col(position) if position else F.lit(0)).alias("__at"))
    asked = requests.select(F.col(session).alias("__s"), F.col(url).alias("__u")).where("__s is not null and __u is not null").distinct()
    path = U.path(F.col("__u"))
    ok = ~F.coalesce(F.col("__secure"), F.lit(False)) | (U.scheme(F.col("__u")) == "https")
    ok = ok & ((path == F.col("__path")) | (path.startswith(F.col("__path")) & (F.col("__path").endswith("/") | path.startswith(F.concat(F.col("__path"), F.lit("/"))))))
    joined = asked.withColumn("__d", F.explode(_suffixes(U.host(F.col("__u"))))).join(c, ["__s", "__d"]).where(ok)
    one = F.struct("__at", "__d", "__path", "__name", F.concat("__name", F.lit("="), "__value").alias("text"))
    headers = joined.groupBy("__s", "__u").agg(F.array_sort(F.collect_list(one)).alias("__all")).select(F.col("__s").alias(session), F.col("__u").alias(url), F.array_join(F.transform("__all", lambda x: x["text"]), "; ").alias("cookie_header"))
    return requests.join(headers, [session, url], "left").select(*requests.columns, "cookie_header")


def inspect(cookies: DataFrame, show_secrets: bool = False) -> DataFrame:
    """Cookies with their values hidden unless asked for."""
    return cookies if show_secrets else cookies.withColumn("value", F.lit(REDACTED))


STORE = "name string, allowed_domains array<string>, sensitive boolean, cookies array<struct<name:string,value:string,domain:string,path:string,expires:bigint,http_only:boolean,secure:boolean,same_site:string>>, storage array<struct<origin:string,kind:string,name:string,value:string>>"


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Stored sessions, one JSON record a line: the columns of ``STORE``; broken records and unfit names are left out."""
    return _fit(spark.read.schema(STORE).json(path))


def write_store(sessions_: DataFrame, path: str, mode: str = "append") -> None:
    """Sessions as JSON lines; names that can't be a file's are refused."""
    _fit(sessions_.select("name", "allowed_domains", "sensitive", "cookies", "storage")).write.mode(mode).json(path)


def without_session(sessions_: DataFrame, name: str) -> DataFrame:
    """The store without one session; a name that isn't there leaves it as it is."""
    return sessions_.where(~F.col("name").eqNullSafe(F.lit(name)))


def store_cookies(sessions_: DataFrame) -> DataFrame:
    """Cookie rows of stored sessions with their stored place."""
    return sessions_.select(F.col("name").alias("session"), F.posexplode("cookies").alias("position", "c")).select("session", "position", "c.*")


def store_views(sessions_: DataFrame) -> DataFrame:
    """``(name, allowed_domains, sensitive, cookies, origins, entries)``: what a list of sessions shows, counts only."""
    return sessions_.select("name", "allowed_domains", F.coalesce("sensitive", F.lit(False)).alias("sensitive"), F.coalesce(F.size("cookies"), F.lit(0)).alias("cookies"), F.coalesce(F.size(F.array_distinct(F.transform("storage", lambda s: s["origin"]))), F.lit(0)).alias("origins"), F.coalesce(F.size("storage"), F.lit(0)).alias("entries"))


def _fit(df: DataFrame, name: str = "name") -> DataFrame:
    return df.where(F.col(name).isNotNull() & ~F.col(name).rlike(r"[/\\:]") & ~F.col(name).isin("", ".", ".."))


def session_names(df: DataFrame, name: str = "name") -> DataFrame:
    """Valid names in order: no separators, not empty, no dots alone."""
    return _fit(df, name).select(name).distinct().orderBy(name)


def candidate_origins(domains: Column, explicit: Column) -> Column:
    """Origins whose storage may be exported: both schemes of each domain and the explicit ones, lower case, sorted."""
    return F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform(domains, lambda d: F.array(F.concat(F.lit("https://"), d), F.concat(F.lit("http://"), d)))), F.transform(explicit, F.lower))))
