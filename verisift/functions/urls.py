"""URL, host and address functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verisift.functions.common import let, strings

# Fixed values.
TRACKING = ["fbclid", "gclid", "ref", "mc_cid", "mc_eid"]
BAD_SUFFIXES = [".localhost", ".local", ".internal", ".home.arpa"]
BAD_HOSTS = ["localhost", "ip6-localhost", "ip6-loopback", "localhost.localdomain", "metadata.goog", "metadatagoog"]
PORTS = [80, 443, 8080, 8443]
BLOCKS_V4 = [
    ("0.0.0.0", 8, "this-network (0.0.0.0/8)"),
    ("10.0.0.0", 8, "private (10.0.0.0/8)"),
    ("100.64.0.0", 10, "carrier-grade NAT (100.64.0.0/10)"),
    ("127.0.0.0", 8, "loopback (127.0.0.0/8)"),
    ("169.254.0.0", 16, "link-local / cloud metadata (169.254.0.0/16)"),
    ("172.16.0.0", 12, "private (172.16.0.0/12)"),
    ("192.168.0.0", 16, "private (192.168.0.0/16)"),
    ("192.0.0.0", 24, "IETF protocol assignments (192.0.0.0/24)"),
    ("192.0.2.0", 24, "documentation (192.0.2.0/24)"),
    ("198.18.0.0", 15, "benchmarking (198.18.0.0/15)"),
    ("198.51.100.0", 24, "documentation (198.51.100.0/24)"),
    ("203.0.113.0", 24, "documentation (203.0.113.0/24)"),
    ("224.0.0.0", 4, "multicast (224.0.0.0/4)"),
    ("240.0.0.0", 4, "reserved (240.0.0.0/4)"),
    ("255.255.255.255", 32, "broadcast (255.255.255.255)"),
]


#: Scheme, user info, host (bracketed or not), port, path and query of an absolute http(s) URL.
_FORM = "(?i)^(https?):/*(?:([^/?#]*)@)?(\\[[^\\]/?#]*\\]|[^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


#: URLs whose canonical form is near: lower-cased named host, no port, no dot segments, a query of unreserved characters.
_PLAIN = "^https?://(?:[a-z0-9-]+\\.)+[a-z][a-z0-9-]*(?:/(?!\\.|%2[eE])[A-Za-z0-9._~%!$'()*+,;=@-]+)*/?(?:\\?[A-Za-z0-9._*&=-]*)?(?:#[^\\x00-\\x20]*)?\\z"
_TRACKED = "(?i)(?:^|&)(?:utm_[^=&]*|" + "|".join(TRACKING) + ")(?:=[^&]*)?(?=&|$)"
_PATH_CHAR = "[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5F\\x61-\\x7A\\x7C\\x7E]"
_ONE_PAIR = "^[A-Za-z0-9._*-]*(?:=[A-Za-z0-9._*-]*)?$"


def _slashed(raw: Column) -> Column:
    """The text with backslashes before a query or fragment as slashes."""
    return let(F.regexp_extract(raw, "^[^?#]*", 0), lambda head: F.concat(F.translate(head, "\\", "/"), F.substring(raw, F.length(head) + 1, F.length(raw))))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^[\\x00-\\x20]+|[\\x00-\\x20]+$|[\\t\\n\\r]", "")


def _cleaned(url: Column) -> Column:
    """A URL as parsers read it: control characters off both ends, tabs and line ends gone, and backslashes before the
    query of an http(s) URL are slashes (`http://localhost\\x` is a path of localhost)."""
    return let(_stripped(url), lambda raw: F.when(raw.rlike("(?i)^https?:[^?#]*\\\\"), _slashed(raw)).otherwise(raw))


def _short_ipv6(address: Column) -> Column:
    """An IPv6 address as URLs have it: lower-case groups without leading zeros, the first longest run of zero groups as
    `::`, an embedded IPv4 address as two groups; null if it is none."""

    def whole(x: Column) -> Column:
        high, low = (F.lower(F.hex(part)) for part in (F.shiftright(x["n"], 16), x["n"].bitwiseAND(65535)))
        return F.when(x["v4"] == "", x["all"]).otherwise(F.concat(F.substring(x["all"], F.lit(1), F.length(x["all"]) - F.length(x["v4"])), high, F.lit(":"), low))

    def short(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # the longest run is looked for first
            run = f"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
            out = F.when(text.rlike(run), F.regexp_replace(text, run, "$1::$2")).otherwise(out)
        return out

    v4 = F.regexp_extract(address, f"(?<=:)({_DOTTED})$", 1)
    bare = let(F.struct(address.alias("all"), v4.alias("v4"), parse_ipv4(v4).alias("n")), whole)
    groups = let(bare, lambda b: F.when(~b.contains("."), expand_ipv6(b)))
    return let(let(groups, lambda g: F.array_join(F.transform(g, lambda x: F.lower(F.hex(x))), ":")), short)


def _encoded(path: Column) -> Column:
    """A path (a bound value) whose characters that URLs don't hold are written as percent codes."""
    one = lambda c: F.when(c.rlike(_PATH_CHAR), c).otherwise(F.url_encode(c))
    return F.when(path.rlike(f"^{_PATH_CHAR}*$"), path).otherwise(F.array_join(F.transform(F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0)), one), ""))


def url_parts(url: Column) -> Column:
    """scheme, user (null without one), host, port (text, null for none or the default), path (at least `/`, dot segments
    resolved, percent codes for what URLs don't hold), query of an http(s) URL; a null struct for anything else, an empty
    host or an impossible port. Hosts are lower-cased, numeric ones written as four decimal parts, IPv6 ones in their short
    form; a host beyond ASCII is refused like an impossible one (write it in its ASCII form first). A null URL gives null.

    Every value that is named more than once is bound by let(): expressions that repeat others grow beyond planning."""

    def of(p: Column) -> Column:
        number = p["number"]
        octet = lambda bits: F.shiftright(number, bits).bitwiseAND(255).cast("string")
        host = F.when(number.isNotNull(), F.concat_ws(".", octet(24), octet(16), octet(8), octet(0))).when(p["host"].startswith("["), F.concat(F.lit("["), p["six"], F.lit("]"))).otherwise(p["host"])
        bad = (p["host"] == "") | p["host"].rlike("[\\s<>^|%\\x00-\\x20\\x7F-\\x{10FFFF}]") | (p["host"].rlike("(^|\\.)(0[xX][0-9a-fA-F]*|[0-9]+)\\.?$") & number.isNull()) | (p["host"].startswith("[") & p["six"].isNull())
        port = p["port"].try_cast("int")
        odd_port = (p["port"] != "") & (port.isNull() | ~p["port"].rlike("^[0-9]+$") | (port > 65535))
        default = F.when(p["scheme"] == "http", 80).otherwise(443)
        made = F.struct(
            p["scheme"].alias("scheme"),
            F.when(F.regexp_replace(p["user"], ":", "") != "", p["user"]).alias("user"),
            host.alias("host"),
            F.when(port != default, port.cast("string")).alias("port"),
            let(let(F.regexp_replace(p["path"], " ", "%20"), _resolved), _encoded).alias("path"),
            p["query"].alias("query"),
        )
        return F.when(p["formed"] & ~bad & ~odd_port, made)

    def named(g: Column) -> Column:
        bare = F.regexp_replace(g["host"], "\\.$", "")
        host = F.when(g["host"].rlike("^[^0-9]+\\.$"), g["host"]).otherwise(bare)
        fields = [g[c].alias(c) for c in ("formed", "scheme", "user", "port", "path", "query")]
        six = F.when(bare.startswith("["), _short_ipv6(F.substring(bare, F.lit(2), F.length(bare) - 2)))
        return let(F.struct(*fields, host.alias("host"), parse_ipv4(bare).alias("number"), six.alias("six")), of)

    def taken(raw: Column) -> Column:
        part = lambda k: F.regexp_extract(raw, _FORM, k)
        return let(F.struct(raw.rlike(_FORM).alias("formed"), F.lower(part(1)).alias("scheme"), part(2).alias("user"), F.lower(part(3)).alias("host"), part(4).alias("port"), part(5).alias("path"), part(6).alias("query")), named)

    return let(_cleaned(url), taken)


def _resolved(path: Column) -> Column:
    """A path (a bound value) with `.` and `..` segments worked out; empty becomes `/`."""
    plain = lambda x: F.regexp_replace(F.lower(x), "%2e", ".")
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    step = lambda a, x: F.when(plain(x) == "..", up(a)).when(plain(x) == ".", a).otherwise(F.concat(a, F.array(x)))

    def dotted(steps: Column) -> Column:
        ends = plain(F.element_at(steps, -1)).isin(".", "..")
        return let(F.aggregate(F.slice(steps, 2, 1 << 30), F.array().cast("array<string>"), step), lambda done: F.concat(F.lit("/"), F.array_join(done, "/"), F.when(ends & (F.size(done) > 0), "/").otherwise("")))

    return F.when(~path.rlike("(?i)(^|/)(\\.|%2e){1,2}(/|$)"), F.when(path == "", "/").otherwise(path)).otherwise(let(F.split(path, "/"), dotted))


def host_of(url: Column) -> Column:
    """Lower-cased host without user info and port (in brackets if it is an IPv6 address), or the raw text if there is none."""
    found = F.regexp_extract(_cleaned(url), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:]+)", 1)
    return F.when(found != "", F.lower(found)).otherwise(url)


def cache_key(url: Column) -> Column:
    """Canonical form: lower-cased scheme and host; no fragment, user info, default port or tracking parameters; other
    parameters decoded, sorted by name and then value, and encoded as a form; dot segments resolved and one closing slash
    dropped unless the path is the root. Null for what isn't an http(s) URL.

    URLs that need no decoding, sorting or resolving, most of any crawl, take compiled regular expressions alone."""
    bare = F.regexp_extract(url, "^[^?#]+", 0)
    tail = F.regexp_replace(F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1), _TRACKED, "")
    tail = F.regexp_replace(tail, "^&+|&+$", "")
    path = F.when(bare.rlike("^https?://[^/]+$"), F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, "^(https?://[^/]+/.+)/$", "$1"))
    pair = F.when(tail == "", "").when(F.contains(tail, F.lit("=")), F.concat(F.lit("?"), tail)).otherwise(F.concat(F.lit("?"), tail, F.lit("=")))
    return F.when(url.rlike(_PLAIN) & tail.rlike(_ONE_PAIR), F.concat(path, pair)).otherwise(_any_cache_key(url))


def _any_cache_key(url: Column) -> Column:

    def of(p: Column) -> Column:
        plain = lambda x: F.coalesce(F.try_url_decode(x), F.regexp_replace(x, "\\+", " "))
        pairs = F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), lambda x: F.struct(plain(F.substring_index(x, "=", 1)).alias("name"), plain(F.when(F.contains(x, F.lit("=")), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("value")))
        kept = F.array_sort(F.filter(pairs, lambda x: ~F.lower(x["name"]).startswith("utm_") & ~F.array_contains(strings(TRACKING), F.lower(x["name"]))))
        tail = F.array_join(F.transform(kept, lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(x["value"]))), "&")
        path = F.when((F.length(p["path"]) > 1) & p["path"].endswith("/"), F.substring(p["path"], F.lit(1), F.length(p["path"]) - 1)).otherwise(p["path"])
        return F.when(p.isNotNull(), F.concat(p["scheme"], F.lit("://"), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")), path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))

    return let(url_parts(url), of)


def safe_url(url: Column) -> Column:
    """The URL without user info, query and fragment, for messages."""
    made = let(url_parts(url), lambda p: F.concat(p["scheme"], F.lit("://"), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")), p["path"]))
    return F.coalesce(made, F.lit("[unparseable-url]"))


def parse_ipv4(host: Column) -> Column:
    """Numeric address of 1 to 4 parts, each decimal, octal (leading 0) or hexadecimal (0x); the last fills the rest."""
    number = lambda p: (
        F.when(p.rlike("^0[xX][0-9A-Fa-f]{1,13}$"), F.conv(F.substring(p, 3, 20), 16, 10).cast("long"))
        .when(p.rlike("^0[0-7]{1,20}$"), F.conv(p, 8, 10).cast("long"))
        .when(p.rlike("^(0|[1-9][0-9]{0,14})$"), p.cast("long"))
    )

    def of(parts: Column) -> Column:
        n, v = F.size(parts), F.transform(parts, number)
        ok = n.between(1, 4) & F.forall(v, lambda x: x.isNotNull()) & F.forall(F.slice(v, 1, n - 1), lambda x: x <= 255)
        last = F.element_at(v, -1)
        room = F.when(n == 1, 1 << 32).when(n == 2, 1 << 24).when(n == 3, 1 << 16).otherwise(256)
        lead = F.coalesce(F.get(v, F.lit(0)), F.lit(0)) * (1 << 24), F.coalesce(F.get(v, F.lit(1)), F.lit(0)) * (1 << 16), F.coalesce(F.get(v, F.lit(2)), F.lit(0)) * 256
        total = F.when(n == 1, last).when(n == 2, lead[0] + last).when(n == 3, lead[0] + lead[1] + last).otherwise(lead[0] + lead[1] + lead[2] + last)
        return F.when(ok & (last < room), total)

    return let(F.split(host, "\\."), of)


def classify_ipv4(value: Column) -> Column:
    """Why the numeric address must not be fetched (first matching block), or null."""

    def of(n: Column) -> Column:
        out = None
        for base, bits, reason in BLOCKS_V4:
            a, b, c, d = map(int, base.split("."))
            lo = (a << 24) + (b << 16) + (c << 8) + d
            hit = n.between(lo, lo + (1 << (32 - bits)) - 1)
            out = F.when(hit, reason) if out is None else out.when(hit, reason)
        return out

    return let(value, of)


def classify_host(host: Column) -> Column:
    """Why the host name must not be fetched, or null."""

    def of(h: Column) -> Column:
        out = F.when(h == "", "empty hostname").when(h.isin(BAD_HOSTS), F.concat(F.lit("internal hostname ("), h, F.lit(")")))
        for s in BAD_SUFFIXES:
            out = out.when((h == s[1:]) | h.endswith(s), f"internal hostname suffix ({s})")
        return out.when(h.rlike("^[0-9a-fx.]+$"), let(classify_ipv4(parse_ipv4(h)), lambda r: F.concat(F.lit("numeric host "), r)))

    return let(F.regexp_replace(F.lower(host), "\\.$", ""), of)


def classify_port(port: Column) -> Column:
    """Why the port must not be connected to, or null; a null port is invalid."""
    return F.when(~F.coalesce(port.between(1, 65535), F.lit(False)), "invalid port").when(~port.isin(PORTS), F.format_string("port %d is not allowed", port))


# --- IPv6 -----------------------------------------------------------------------------------------------------

_GROUP = "^[0-9a-fA-F]{1,4}$"
_DOTTED = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"


def expand_ipv6(address: Column) -> Column:
    """The 8 groups of an address as numbers, or null. A zone is cut off. Groups of an embedded IPv4 address count as zero
    after `::`; without `::` such an address is not accepted."""
    cut = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")

    def of(p: Column) -> Column:
        at = F.instr(p["text"], "::")
        twice = F.contains(F.substring(p["text"], at + 1, F.length(p["text"])), F.lit("::"))
        head = F.when(at > 0, cut(F.substring(p["text"], F.lit(1), at - 1))).otherwise(F.split(p["text"], ":"))
        rest = F.when(at > 0, cut(F.substring(p["text"], at + 2, F.length(p["text"])))).otherwise(F.array().cast("array<string>"))

        def join(s: Column) -> Column:
            fill = 8 - F.size(s["h"]) - F.size(s["r"])
            groups = F.when(at > 0, F.concat(s["h"], F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), s["r"])).otherwise(s["h"])
            ok = F.forall(groups, lambda g: g.rlike(_GROUP)) & F.when(at > 0, (fill >= 0) & ~twice).otherwise((F.size(s["h"]) == 8) & ~p["dotted"])
            return F.when(ok & (~p["dotted"] | p["v4"].isNotNull()), F.transform(groups, lambda g: F.conv(g, 16, 10).cast("int")))

        return let(F.struct(head.alias("h"), rest.alias("r")), join)

    def split(x: Column) -> Column:
        dotted = F.contains(x["tail"], F.lit("."))
        text = F.when(dotted, F.concat(F.substring(x["bare"], F.lit(1), F.length(x["bare"]) - F.length(x["tail"])), F.lit("0:0"))).otherwise(x["bare"])
        return let(F.struct(text.alias("text"), dotted.alias("dotted"), F.when(dotted, parse_ipv4(x["tail"])).alias("v4")), of)

    bare = F.substring_index(address, "%", 1)
    return let(F.struct(bare.alias("bare"), F.substring_index(bare, ":", -1).alias("tail")), split)


def classify_ipv6(address: Column) -> Column:
    """Why the address must not be fetched, or null."""

    def of(g: Column) -> Column:
        zero = lambda k: F.forall(F.slice(g, 1, k), lambda x: x == 0)
        first = g[0]
        inner = classify_ipv4(g[6].cast("long") * 65536 + g[7])
        return (
            F.when(g.isNull(), "unparseable IPv6 address")
            .when(zero(7) & (g[7] == 1), "IPv6 loopback (::1)")
            .when(zero(8), "IPv6 unspecified (::)")
            .when(first.bitwiseAND(0xFFC0) == 0xFE80, "IPv6 link-local (fe80::/10)")
            .when(first.bitwiseAND(0xFE00) == 0xFC00, "IPv6 unique-local (fc00::/7)")
            .when(first.bitwiseAND(0xFF00) == 0xFF00, "IPv6 multicast (ff00::/8)")
            .when(zero(5) & (g[5] == 0xFFFF) & inner.isNotNull(), F.concat(F.lit("IPv4-mapped "), inner))
        )

    return let(expand_ipv6(address), of)


def classify_ip(address: Column) -> Column:
    """Why the IP address must not be fetched, or null; what is no IP address must not be fetched either."""

    def of(x: Column) -> Column:
        plain = x["plain"]
        groups = F.size(F.filter(F.split(plain, ":"), lambda g: g != ""))
        v6 = ~plain.contains(":::") & ~plain.rlike("::.*::|[^0-9a-fA-F:]|[0-9a-fA-F]{5}|^:[^:]|[^:]:$") & F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8) & ~x["address"].rlike("%$")
        return F.when(x["address"].rlike(f"^{_DOTTED}$"), classify_ipv4(parse_ipv4(x["address"]))).when(plain.contains(":") & v6, classify_ipv6(x["address"])).otherwise("not a valid IP address")

    plain = F.regexp_replace(F.substring_index(address, "%", 1), _DOTTED + "$", "0:0")
    return let(F.struct(address.alias("address"), plain.alias("plain")), of)


def validate_url(url: Column, addresses: Column) -> Column:
    """code and reason why the URL must not be fetched, the first that holds, or a null struct if it may be. `addresses`
    is what its host resolved to; null counts as nothing resolved. A null URL isn't a URL."""
    no = lambda code, reason: F.struct(F.lit(code).alias("code"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))

    def of(x: Column) -> Column:
        p = x["parts"]
        port = F.coalesce(p["port"].cast("int"), F.when(p["scheme"] == "https", 443).otherwise(80))
        named = F.struct(x["scheme"].alias("scheme"), p.isNull().alias("none"), p["user"].alias("user"), F.regexp_replace(p["host"], "^\\[|\\]$", "").alias("host"), port.alias("port"), x["known"].alias("known"))
        return let(named, judged)

    def judged(x: Column) -> Column:
        literal = x["host"].rlike("^[0-9.]+$") | x["host"].contains(":") | x["host"].startswith("0x")
        #: Every address once: the host itself if it is one.
        reasons = F.transform(F.when(literal, F.array(x["host"])).otherwise(x["known"]), classify_ip)
        found = F.struct(x["scheme"].alias("scheme"), x["none"].alias("none"), x["user"].alias("user"), classify_host(x["host"]).alias("host"), classify_port(x["port"]).alias("port"), literal.alias("literal"), F.size(x["known"]).alias("n"), F.get(F.filter(reasons, lambda r: r.isNotNull()), F.lit(0)).alias("ip"))
        return let(found, told)

    def told(f: Column) -> Column:
        return (
            F.when(F.coalesce(f["scheme"], F.lit("")) == "", no("INVALID_URL", "not a valid absolute URL"))
            .when(~f["scheme"].isin("http", "https"), no("INVALID_URL", F.concat(F.lit("unsupported scheme "), f["scheme"])))
            .when(f["none"], no("INVALID_URL", "not a valid absolute URL"))
            .when(f["user"].isNotNull(), no("BLOCKED_URL", "URLs containing credentials are not allowed"))
            .when(f["host"].isNotNull(), no("BLOCKED_URL", f["host"]))
            .when(f["port"].isNotNull(), no("BLOCKED_URL", f["port"]))
            .when(f["literal"] & f["ip"].isNotNull(), no("BLOCKED_URL", f["ip"]))
            .when(f["literal"], F.lit(None))
            .when(f["n"] == 0, no("INVALID_URL", "hostname did not resolve"))
            .when(f["ip"].isNotNull(), no("BLOCKED_URL", F.concat(F.lit("resolved "), f["ip"])))
        )

    scheme = F.lower(F.regexp_extract(F.trim(url), "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    known = F.coalesce(addresses, F.array().cast("array<string>"))
    return let(F.struct(scheme.alias("scheme"), url_parts(url).alias("parts"), known.alias("known")), of)


# --- resolving ------------------------------------------------------------------------------------------------


def write_url(url: Column) -> Column:
    """An http(s) URL as parsers write it, without its fragment; null for what isn't one."""
    made = lambda p: F.concat(p["scheme"], F.lit("://"), F.coalesce(F.concat(p["user"], F.lit("@")), F.lit("")), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")), p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    return let(url_parts(url), made)


def resolve_url(base: Column, reference: Column) -> Column:
    """What a reference on the page `base` points to, as write_url() has it: a whole URL, or one that takes the scheme, the
    host, the folder or the whole path from the base. Null if that is no http(s) URL; an empty reference is the base."""

    def joined(x: Column) -> Column:
        p, r = x["p"], x["r"]
        origin = F.concat(p["scheme"], F.lit("://"), F.coalesce(F.concat(p["user"], F.lit("@")), F.lit("")), p["host"], F.coalesce(F.concat(F.lit(":"), p["port"]), F.lit("")))
        query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
        return (
            F.when(r.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), r)
            .when(r.startswith("//"), F.concat(p["scheme"], F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when(r.startswith("?"), F.concat(origin, p["path"], r))
            .when(r.rlike("^(#|$)"), F.concat(origin, p["path"], query))
            .otherwise(F.concat(origin, F.regexp_extract(p["path"], "^.*/", 0), r))
        )

    return write_url(let(F.struct(url_parts(base).alias("p"), let(_stripped(reference), _slashed).alias("r")), joined))
