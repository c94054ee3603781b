"""Classification by ordered patterns: catalogue items, clients, prices; weather records as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (name, pattern); the first that matches counts.
CATEGORIES = [
    ("search", r"\bsearch\b|\bserp\b|google trends|\bquery\b|web search|\bfind\b"),
    ("retrieval", r"\bretriev|\bcontents?\b|\bcrawl|\bscrape|\bextract|\bfetch\b|\bmarkdown\b|\bread (a|the) (web ?page|page|url)|\burl"),
    ("verification", r"\bverif|\bevidence\b|\bfact.?check|\bcitation|\bprovenance\b|\battest|\bclaims?\b"),
    ("crypto-data", r"\bprice\b|\bcandle|\bohlc|\bswap|\bliquidat|\byield\b|\bgas\b|\bwallet\b|\bonchain\b|\btoken|\bblockchain\b|\bdex\b|\bperp|\bfunding rate|\btvl\b|\bdefi\b"),
    ("social", r"\btwitter\b|\bx\.com\b|\breddit|\bsocial\b|\btelegram|\bdiscord|\bfarcaster|\blinkedin|\binstagram|\btiktok|\byoutube\b"),
    ("ai-media", r"\bimage\b|\bvideo\b|\bspeech\b|\btranscri|\btts\b|\bvoice\b|\bmusic\b|\bgenerat|\bllm\b|\bchat\b|\bcompletion|\bembedding|\bprompt\b"),
    ("data-other", r"\bweather\b|\bgeocod|\bmaps?\b|\bflight|\bnews\b|\bemail\b|\benrich|\bcompany\b|\bpeople\b|\btranslate\b|\bdns\b|\bwhois\b"),
]
CLIENTS = [
    ("gptbot", "GPTBot"), ("oai-search", "OAI-SearchBot"), ("chatgpt-user", "ChatGPT-User"), ("claudebot", "ClaudeBot|Claude-Web|anthropic-ai"),
    ("perplexitybot", "PerplexityBot|Perplexity-User"), ("google-extended", "Google-Extended"), ("ccbot", "CCBot"), ("applebot", "Applebot"),
    ("googlebot", "Googlebot"), ("bingbot", "bingbot"), ("mcpbeat", "mcpbeat"), ("agentrankprobe", "AgentRankProbe"), ("x402station", "x402station"),
    ("mcp-health-probe", "mcp-health-probe"), ("carbonmonitor", "CarbonMonitor"), ("mcprush", "mcprush"), ("payai", "payai"), ("curl", "^curl/"),
    ("node", "^node|undici|axios|node-fetch"), ("python", "python-requests|python-urllib|aiohttp|httpx"), ("go", "^Go-http-client"),
    ("browser", r"Mozilla/5\.0.*(Chrome|Firefox|Safari|Edg)/"),
]


def _first(x: Column, rules: list[tuple[str, str]], flags: str, other: str) -> Column:
    out = None
    for name, pattern in rules:
        hit = x.rlike(flags + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(other)


def categorize(*parts: Column) -> Column:
    return _first(F.lower(F.concat_ws(" ", *parts)), CATEGORIES, "", "uncategorized")


def classify_client(agent: Column) -> Column:
    return F.when(F.coalesce(agent, F.lit("")) == "", "none").otherwise(_first(agent, CLIENTS, "(?i)", "other"))


def known_client(token: Column) -> Column:
    """A client token that classify_client() may give; null for any other, which a caller may have made up."""
    return F.when(token.isin([name for name, _ in CLIENTS] + ["other", "none"]), token)


def price_atomic(price: Column) -> Column:
    """Millionths of a dollar of a price text like `$0.01`; null unless positive."""
    n = F.round(F.regexp_replace(price, "^\\$", "").try_cast("decimal(24,9)") * 1_000_000).cast("bigint")
    return F.when(n > 0, n)


def price_string(atomic: Column) -> Column:
    """Shortest exact dollar text."""
    text = (atomic.cast("decimal(24,6)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(24,6)").cast("string")
    return F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", ""))


def format_alert(a: Column) -> Column:
    """Lines of an alert struct (event, areaDesc, severity, description, instruction); nulls have fixed texts."""
    part = lambda label, field, none: F.concat(F.lit(label + ": "), F.coalesce(a[field], F.lit(none)))
    return F.concat_ws("\n", part("Event", "event", "Unknown"), part("Area", "areaDesc", "Unknown"), part("Severity", "severity", "Unknown"), part("Description", "description", "No description available"), part("Instructions", "instruction", "No specific instructions provided"), F.lit("---"))


def format_period(p: Column) -> Column:
    part = lambda field, none: F.coalesce(p[field], F.lit(none))
    temperature = F.when(p["temperature"].isNull(), "Temperature: Unknown").otherwise(F.concat(F.lit("Temperature: "), p["temperature"].cast("string"), F.lit("°"), part("temperatureUnit", "F")))
    wind = F.concat(F.lit("Wind: "), part("windSpeed", "Unknown"), F.lit(" "), part("windDirection", "Unknown"))
    return F.concat_ws("\n", F.concat(part("name", "Unknown"), F.lit(":")), temperature, wind, part("detailedForecast", "No forecast available"), F.lit("---"))
