"""Columns about services: names, kinds, purposes, ports, hosts and import targets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codestrata.functions import fixed
from codestrata.functions.text import basename, col, contains_any


def _drop_suffix(c: Column, suffix: str) -> Column:
    return F.when(c.endswith(suffix), F.left(c, F.length(c) - len(suffix))).otherwise(c)


def _drop_prefix(c: Column, prefix: str) -> Column:
    return F.when(c.startswith(prefix), F.substring(c, len(prefix) + 1, 2_147_483_647)).otherwise(c)


def trim_service(name: Column | str) -> Column:
    return _drop_suffix(col(name), "-service")


def display_name(path: Column | str) -> Column:
    name = basename(path)
    for suffix in ("-service", "_service"):
        name = _drop_suffix(name, suffix)
    for prefix in ("service-", "service_"):
        name = _drop_prefix(name, prefix)
    words = F.split(F.replace(name, F.lit("-"), F.lit(" ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2_147_483_647))), " ")


def service_kind(purpose: Column | str) -> Column:
    low = F.lower(col(purpose))
    out = None
    for words, kind in fixed.SERVICE_KINDS:
        test = contains_any(low, words)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise(fixed.FALLBACK_SERVICE_KIND)


def service_purpose(name: Column | str, api_type: Column | str) -> Column:
    """Purpose of the first known word of the name, else by API type."""
    known = F.create_map(*[F.lit(x) for words, sentence in fixed.SERVICE_PURPOSES for w in words for x in (w, sentence)])
    hits = F.filter(F.transform(F.split(F.lower(col(name)), "-"), lambda w: F.try_element_at(known, w)),
                    lambda p: p.isNotNull())
    prefix = F.create_map(*[F.lit(x) for kv in fixed.API_PURPOSES.items() for x in kv])
    return F.coalesce(F.get(hits, F.lit(0)),
                      F.concat(F.coalesce(F.try_element_at(prefix, col(api_type)), F.lit(fixed.API_FALLBACK_PURPOSE)), col(name)))


def port_of(content: Column | str) -> Column:
    return F.regexp_extract(col(content), fixed.PORT_PATTERN, 1)


# --- hosts and imports -----------------------------------------------------------------

_IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def _service_host(host: Column) -> Column:
    return F.when((host == "localhost") | host.rlike(_IPV4), "").otherwise(trim_service(host))


def host_of(url: Column | str) -> Column:
    """Service named by the host of a URL; empty for localhost and addresses."""
    bare = F.regexp_replace(F.regexp_replace(col(url), "^http://", ""), "^https://", "")
    return _service_host(F.substring_index(F.substring_index(bare, "/", 1), ":", 1))


def host_of_address(address: Column | str) -> Column:
    return _service_host(F.substring_index(col(address), ":", 1))


def service_of_import(path: Column | str) -> Column:
    """``.../services/x/...`` or ``.../clients/xservice``; empty when neither occurs."""
    by_service = F.regexp_extract(col(path), r"(?:^|/)services/([^/]*)", 1)
    by_client = F.regexp_extract(col(path), r"(?:^|/)clients/([^/]*)", 1)
    has_service = col(path).rlike(r"(?:^|/)services/")
    return F.when(has_service, trim_service(by_service)).otherwise(
        _drop_suffix(_drop_suffix(by_client, "service"), "client"))


# --- repository URLs ------------------------------------------------------------------

def repo_url_facts(df, column: str):
    """Validity, owner, name, clone URL, masked URL and safe key of a repository URL."""
    url = col(column)
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    bare = F.regexp_replace(url, r"\.git$", "")
    parts = F.split(_drop_prefix(bare, fixed.HOST_PREFIX), "/")
    enough = F.size(parts) >= 2
    https = F.when(bare.startswith(fixed.SSH_PREFIX),
                   F.concat(F.lit(fixed.HOST_PREFIX), _drop_prefix(bare, fixed.SSH_PREFIX))).otherwise(bare)
    masked = F.split(url, fixed.MASK_MARK.replace(".", r"\."))
    segs = F.split(bare, "/")
    domain = F.replace(F.get(segs, F.lit(2)), F.lit("."), F.lit("-"))
    known = bare.startswith(fixed.HOST_PREFIX) & enough
    plain = F.left(F.translate(bare, "/:.?&= ", "------_"), F.lit(fixed.SAFE_KEY_CHARS))
    key = (F.when(known, F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
           .when(bare.startswith("http") & (F.size(segs) >= 5), F.concat_ws("-", domain, F.get(segs, F.lit(3)), F.get(segs, F.lit(4))))
           .when(bare.startswith("http") & (F.size(segs) >= 3), domain)
           .otherwise(plain))
    return df.withColumns({
        "is_valid": url.startswith(fixed.HOST_PREFIX) & (slashes >= 4),
        "owner": F.when(enough, F.get(parts, F.lit(0))).otherwise(""),
        "name": F.when(enough, F.get(parts, F.lit(1))).otherwise(""),
        "clone_url": F.when(https.startswith(fixed.HOST_PREFIX), F.concat(https, F.lit(".git"))).otherwise(https),
        "masked_url": F.when(url.contains(fixed.MASK_MARK) & (F.size(masked) == 2),
                             F.concat(F.lit("https://***@github.com/"), F.get(masked, F.lit(1)))).otherwise(url),
        "safe_key": key,
    })


