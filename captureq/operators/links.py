"""Links, titles, media, banners and responsive candidates from HTML text, by built-in functions on the JVM.

Pages are read as a parser reads their tokens (see `functions.html`): nothing in comments, scripts and raw text counts,
quotes may stand anywhere, tags of any length are read once. A null page has no elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from captureq.functions import html
from captureq.functions.text import bound, trim_all
from captureq.functions.url import absolute, is_web, parseable


def _target(attrs: Column, name: str) -> Column:
    """A url attribute's value without the white space around it and the line breaks and tabs in it."""
    return F.regexp_replace(F.regexp_replace(html.value(attrs, name), r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def page_base(text: Column, url: Column) -> Column:
    """What relative targets of a page are resolved against: the first base element that has a target, itself resolved
    against the page's url, else (also where that is no url) the page's url."""
    bases = F.transform(F.filter(html.start_tags(text), lambda t: t.rlike(r"(?i)^<base[\s/>]")), html.attributes)
    first = F.get(F.filter(F.transform(bases, lambda a: _target(a, "href")), lambda h: h.isNotNull()), F.lit(0))
    fit = lambda b: F.when(parseable(b), b)
    return F.when(text.rlike(r"(?i)<base[\s/]"), F.coalesce(bound(absolute(first, url), fit), url)).otherwise(url)


def anchors(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page, pos, href (absolute, as it stands where no url can be made of it), text (trimmed, 200 characters at most),
    rel (null where empty), in document order; a position counts the anchors that have a target.

    Null html has no links; a null url leaves relative targets null; an empty target is the page itself. Columns but id,
    url and html are not read. All of an anchor is worked out before it becomes a row, so that no filter repeats it."""
    told = pages.select(F.col(id_col).alias("page_id"), page_base(F.col("html"), F.col("url")).alias("base"), html.anchor_elements(F.col("html")).alias("e"))
    read = F.filter(F.transform("e", lambda e: F.struct(e.alias("e"), html.attributes(html.first_tag(e)).alias("a"))), lambda x: F.array_contains(x["a"]["names"], "href"))
    text = lambda x: F.substring(trim_all(html.text_of(x["e"])), 1, 200)
    read = F.transform(read, lambda x: F.struct(_target(x["a"], "href").alias("href"), text(x).alias("text"), F.nullif(html.value(x["a"], "rel"), F.lit("")).alias("rel")))
    rows = F.transform(read, lambda x: F.struct(absolute(x["href"], F.col("base")).alias("href"), x["text"].alias("text"), x["rel"].alias("rel")))
    each = told.select("page_id", F.posexplode(rows).alias("pos", "r"))
    return each.select("page_id", F.col("pos").cast("long").alias("pos"), "r.href", "r.text", "r.rel")


def outbound_links(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Web links of each page, the first of equal targets."""
    first = F.row_number().over(Window.partitionBy("page_id", "href").orderBy("pos"))
    return anchors(pages, id_col).filter(is_web(F.col("href"))).withColumn("_n", first).filter("_n = 1").drop("_n")


def titles(pages: DataFrame) -> DataFrame:
    """Page title (of the first title element), or the url where it is empty."""
    return pages.select("page_id", F.coalesce(F.nullif(trim_all(html.title_text(F.col("html"))), F.lit("")), F.col("url")).alias("title"))


def srcset_urls(value: Column) -> Column:
    """First token of each comma-separated candidate."""
    return F.filter(F.transform(F.split(value, ","), lambda c: F.element_at(F.split(F.trim(c), r"\s+"), 1)), lambda u: u != "")


def responsive_candidates(pages: DataFrame) -> DataFrame:
    """page_id, candidates: absolute urls of src, data-src, data-lazy-src, poster and every srcset candidate, each once.

    Elements are img, source and whatever has one of the other attributes; they are looked at in document order, the
    attributes of one in that order. Null html has no candidates."""
    lazy = ("data-src", "data-srcset", "data-lazy-src", "poster")
    told = pages.select("page_id", page_base(F.col("html"), F.col("url")).alias("base"), html.start_tags(F.col("html")).alias("t"))
    tags = F.filter("t", lambda t: t.rlike(rf"(?i)^<(?:img|source)\b|[\s/\"']({'|'.join(lazy)})[\s/=>]"))
    read = F.transform(tags, lambda t: F.struct(t.rlike(r"(?i)^<(?:img|source)[\s/>]").alias("image"), html.attributes(t).alias("a")))
    read = F.filter(read, lambda x: x["image"] | F.arrays_overlap(x["a"]["names"], F.array(*map(F.lit, lazy))))

    def urls(attrs: Column) -> Column:
        plain = F.array(*[F.nullif(_target(attrs, n), F.lit("")) for n in ("src", "data-src", "data-lazy-src", "poster")])
        sets = F.flatten(F.array(*[F.coalesce(srcset_urls(html.value(attrs, n)), F.array().cast("array<string>")) for n in ("srcset", "data-srcset")]))
        return F.concat(plain, sets)

    every = F.transform(F.flatten(F.transform(read, lambda x: urls(x["a"]))), lambda u: absolute(F.trim(u), F.col("base")))
    return told.select("page_id", F.array_distinct(F.filter(every, lambda u: F.coalesce(is_web(u), F.lit(False)))).alias("candidates"))


def stylesheet_urls(css: Column, base: Column) -> Column:
    """Targets of url(...) resolved against the sheet, without data: urls."""
    found = F.regexp_extract_all(css, F.lit(r"""(?i)url\(\s*(["']?)(.*?)\1\s*\)"""), 2)
    return F.array_distinct(F.transform(F.filter(found, lambda u: (u != "") & ~F.lower(u).startswith("data:")), lambda u: absolute(u, base)))


#: Consent-management roots, in the order in which a framework is named.
CMP = [
    ("OneTrust", "#onetrust-banner-sdk"), ("OneTrust", "#onetrust-consent-sdk"), ("OneTrust", "#onetrust-pc-sdk"), ("OneTrust", ".onetrust-pc-dark-filter"),
    ("Cookiebot", "#CybotCookiebotDialog"), ("Cookiebot", "#CybotCookiebotDialogBodyUnderlay"), ("Quantcast", ".qc-cmp2-container"),
    ("Didomi", "#didomi-popup"), ("Didomi", ".didomi-popup-container"), ("Didomi", "#didomi-host"),
    ("TrustArc", "#truste-consent-track"), ("TrustArc", ".truste_box_overlay"), ("TrustArc", "#consent_blackbar"), ("Sourcepoint", '[id^="sp_message_container"]'),
    ("Osano", ".osano-cm-window"), ("CookieLawInfo", "#cookie-law-info-bar"), ("InsitesCookieConsent", ".cc-window"), ("Klaro", ".klaro"), ("Usercentrics", "#usercentrics-root"),
]


#: Which overlays a page is freed of where a request does not say.
HEURISTIC = {"enabled": True, "min_ratio": 0.3, "min_z": 1000}


def _matches(selector: str, ids: Column, classes: Column) -> Column:
    """Whether a selector of the forms #id, .class and [id^="prefix"] finds an element: names are matched exactly."""
    if selector.startswith("#"):
        return F.array_contains(ids, selector[1:])
    if selector.startswith("."):
        return F.array_contains(classes, selector[1:])
    prefix = selector.split('"')[1]
    return F.exists(ids, lambda i: i.startswith(prefix))


def consent_banners(pages: DataFrame, excluded: list[str] | None = None, custom: list[tuple[str, str]] | None = None) -> DataFrame:
    """page_id, framework (first hit, else null), removed (array of matching selectors); excluded frameworks are left
    out, custom entries come last. The ids and classes of a page are read once, all selectors look at them."""
    entries = [e for e in CMP if e[0] not in (excluded or [])] + (custom or [])
    tags = F.filter(html.start_tags(F.col("html")), lambda t: t.rlike(r"(?i)[\s/\"'](?:id|class)[\s=]"))
    named = pages.select("page_id", F.transform(tags, html.attributes).alias("t"))
    ids = F.filter(F.transform("t", lambda a: html.value(a, "id")), lambda x: x.isNotNull())
    classes = F.flatten(F.filter(F.transform("t", lambda a: F.split(html.value(a, "class"), r"\s+")), lambda x: x.isNotNull()))
    told = named.select("page_id", F.array_distinct(ids).alias("ids"), F.array_distinct(classes).alias("classes"))
    hit = [F.when(_matches(s, F.col("ids"), F.col("classes")), F.struct(F.lit(f).alias("f"), F.lit(s).alias("s"))) for f, s in entries]
    told = told.select("page_id", F.filter(F.array(*hit), lambda x: x.isNotNull()).alias("h"))
    return told.select("page_id", F.get("h", F.lit(0))["f"].alias("framework"), F.transform("h", lambda x: x["s"]).alias("removed"))


def dismiss_options(specs: DataFrame, spec_col: str = "spec") -> DataFrame:
    """The banner options of each request: spec is a VARIANT that holds nothing, a boolean or an object.

    active (false for absent, null and false), excluded, custom selectors, use_defaults, fail_on_error and the
    heuristic's fields, each with its default where the object leaves it out."""
    v = F.col(spec_col)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    flag = get("$", "boolean")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    active = v.isNotNull() & ~F.is_variant_null(v) & F.coalesce(is_object | flag, F.lit(False))
    none = F.array().cast("array<string>")
    heuristic = F.struct(
        F.coalesce(get("$.heuristic.enabled", "boolean"), F.lit(HEURISTIC["enabled"])).alias("enabled"),
        F.coalesce(get("$.heuristic.minViewportCoverageRatio", "double"), F.lit(HEURISTIC["min_ratio"])).alias("min_ratio"),
        F.coalesce(get("$.heuristic.minZIndex", "long"), F.lit(HEURISTIC["min_z"])).alias("min_z"),
    )
    return specs.withColumns(
        {
            "active": active,
            "use_defaults": F.coalesce(get("$.useDefaults", "boolean"), F.lit(True)),
            "excluded": F.coalesce(get("$.excludeFrameworks", "array<string>"), none),
            "custom": F.coalesce(get("$.extraSelectors", "array<string>"), none),
            "heuristic": heuristic,
            "fail_on_error": F.coalesce(get("$.failOnError", "boolean"), F.lit(False)),
        }
    )


def media_urls(pages: DataFrame) -> DataFrame:
    """page_id, pos, urls: for each video or audio element its src, poster and its sources, absolute, each once. An
    element that is never closed holds the rest of its page."""
    told = pages.select("page_id", page_base(F.col("html"), F.col("url")).alias("base"), html.media_elements(F.col("html")).alias("e"))

    def urls(element: Column) -> Column:
        tags = F.filter(html.start_tags(element), lambda t: t.rlike(r"(?i)^<(?:video|audio|source)[\s/>]"))
        # The first tag is the element's own; it alone has a poster.
        read = F.transform(tags, lambda t, i: F.struct(html.attributes(t).alias("a"), (i == 0).alias("own"), t.rlike(r"(?i)^<source").alias("source")))
        found = F.transform(F.filter(read, lambda x: x["own"] | x["source"]), lambda x: F.array(_target(x["a"], "src"), F.when(x["own"], _target(x["a"], "poster"))))
        return F.array_distinct(F.transform(F.filter(F.flatten(found), lambda u: F.coalesce(u != "", F.lit(False))), lambda u: absolute(u, F.col("base"))))

    each = told.select("page_id", F.posexplode(F.transform("e", urls)).alias("pos", "urls"))
    return each.select("page_id", F.col("pos").cast("long").alias("pos"), "urls")


def image_urls(html: Column, host_token: str) -> Column:
    """Image urls anywhere in the text whose host part holds the token, each once."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)(https?://[^\s"'<>()\\]+\.(?:jpe?g|png|webp|gif|avif))"""), 1)
    return F.array_distinct(F.filter(found, lambda u: F.lower(u).contains(host_token)))


def size_siblings(urls: Column) -> Column:
    """Each url and its half and double size variants, where it has a size."""
    from captureq.functions.text import scale_dims

    return F.array_distinct(F.filter(F.flatten(F.transform(urls, lambda u: F.array(u, scale_dims(u, 2.0), scale_dims(u, 0.5)))), lambda u: u.isNotNull()))


def never_requested(candidates: DataFrame, requested: DataFrame, most: int = 2000) -> DataFrame:
    """Candidate counts of each page and those that no request named, the first `most` of them in order.

    candidates: page_id, candidates array; requested: page_id, url."""
    seen = requested.groupBy("page_id").agg(F.collect_set("url").alias("seen"))
    left = F.array_except("candidates", F.coalesce("seen", F.array().cast("array<string>")))
    out = candidates.join(seen, "page_id", "left").select("page_id", F.size("candidates").alias("candidates"), left.alias("left"))
    return out.select("page_id", "candidates", F.size("left").alias("never_requested"), F.slice("left", 1, most).alias("fetch"))


def overlays(elements: DataFrame, min_z: int, min_ratio: float) -> DataFrame:
    """Elements that cover a page: fixed or sticky, high enough, large enough, outside landmarks and not inside another
    one (page_id, path, position, z, area, viewport_area, landmark). A path names its ancestors before it."""
    hit = elements.filter(F.col("position").isin("fixed", "sticky") & (F.col("z") >= min_z) & (F.col("viewport_area") > 0) & (F.col("area") / F.nullif("viewport_area", F.lit(0)) >= min_ratio) & ~F.col("landmark"))
    paths = hit.groupBy("page_id").agg(F.collect_list("path").alias("all"))
    return hit.join(paths, "page_id").filter(~F.exists("all", lambda p: F.col("path").startswith(F.concat(p, F.lit("/"))))).drop("all")


def pem_blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)(-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----)"), 1)
