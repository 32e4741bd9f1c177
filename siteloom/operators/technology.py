"""Technologies of a page, by patterns over its headers, markup, meta tags and scripts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions.text import let

# Fixed values: (name, category, headers, markup, generator, scripts), in the order of detection.
TECHNOLOGIES: list[tuple[str, str, list[tuple[str, str]], str, str, str]] = [
    ("React", "JavaScript Framework", [], r"(?i:data-reactroot|data-reactid)|__NEXT_DATA__", "", r"react\.production\.min\.js|react-dom"),
    ("Next.js", "JavaScript Framework", [("x-powered-by", r"(?i)Next\.js")], r"__NEXT_DATA__|_next/static", "", ""),
    ("Nuxt.js", "JavaScript Framework", [], r"__NUXT__|_nuxt/", "", ""),
    ("Vue.js", "JavaScript Framework", [], r"(?i:data-v-[a-f0-9])|vue\.runtime", "", r"vue\.min\.js|vue\.global"),
    ("Angular", "JavaScript Framework", [], r"ng-version|ng-app|\[ngClass\]|\(click\)", "", r"angular\.min\.js|@angular/core"),
    ("Svelte", "JavaScript Framework", [], r"(?i:svelte-[a-z0-9])|__sveltekit", "", ""),
    ("Gatsby", "JavaScript Framework", [], r"___gatsby|gatsby-image", "", ""),
    ("Astro", "JavaScript Framework", [("x-astro", ".")], r"astro-island|astro-slot", "", ""),
    ("WordPress", "CMS", [], r"wp-content/|wp-includes/|wp-json/", "(?i)WordPress", ""),
    ("Drupal", "CMS", [("x-drupal-cache", ".")], r"sites/default/files|drupal\.js", "(?i)Drupal", ""),
    ("Shopify", "E-commerce", [("x-shopid", ".")], r"cdn\.shopify\.com|Shopify\.theme", "", ""),
    ("Squarespace", "CMS", [], r"squarespace\.com|sqsp", "", ""),
    ("Wix", "CMS", [], r"wix\.com|wixsite\.com|_wix_browser_sess", "", ""),
    ("Webflow", "CMS", [], r"webflow\.com|w-webflow", "(?i)Webflow", ""),
    ("Tailwind CSS", "CSS Framework", [], r'class="[^"]*(?:flex|grid|bg-|text-|p-|m-|w-|h-)[^"]*"', "", ""),
    ("Bootstrap", "CSS Framework", [], r'class="[^"]*(?:container|row|col-|btn |navbar)[^"]*"|bootstrap\.min', "", r"bootstrap\.min\.js|bootstrap\.bundle"),
    ("Google Analytics", "Analytics", [], r"google-analytics\.com|gtag/js|GoogleAnalyticsObject|ga\.js", "", r"googletagmanager\.com/gtag|google-analytics\.com/analytics"),
    ("Google Tag Manager", "Analytics", [], r"googletagmanager\.com/gtm|GTM-[A-Z0-9]+", "", ""),
    ("Plausible", "Analytics", [], "", "", r"plausible\.io/js"),
    ("Vercel Analytics", "Analytics", [], r"vercel-insights", "", r"vercel-analytics|va\.vercel-scripts\.com"),
    ("Hotjar", "Analytics", [], r"hotjar\.com|hj\('identify'\)", "", r"static\.hotjar\.com"),
    ("Vercel", "Hosting", [("x-vercel-id", "."), ("server", "(?i)Vercel")], "", "", ""),
    ("Netlify", "Hosting", [("server", "(?i)Netlify")], "", "", ""),
    ("Cloudflare", "CDN", [("server", "(?i)cloudflare"), ("cf-ray", ".")], "", "", ""),
    ("AWS CloudFront", "CDN", [("x-amz-cf-id", "."), ("server", "(?i)CloudFront")], "", "", ""),
    ("Nginx", "Web Server", [("server", "(?i)nginx")], "", "", ""),
    ("Apache", "Web Server", [("server", "(?i)Apache")], "", "", ""),
    ("jQuery", "JavaScript Library", [], "jQuery", "", r"jquery\.min\.js|jquery-[0-9]"),
    ("Font Awesome", "Icon Library", [], "font-awesome|fontawesome", "", "fontawesome"),
    ("Google Fonts", "Font Service", [], r"fonts\.googleapis\.com|fonts\.gstatic\.com", "", ""),
    ("reCAPTCHA", "Security", [], r"recaptcha|google\.com/recaptcha", "", "recaptcha"),
    ("Stripe", "Payment", [], "stripe", "", r"js\.stripe\.com"),
    ("Intercom", "Customer Support", [], "intercom", "", r"widget\.intercom\.io"),
    ("Crisp", "Customer Support", [], "", "", r"client\.crisp\.chat"),
]
GENERATOR = r"(?i)<meta[^>]*name=[\"']generator[\"'][^>]*content=[\"']([^\"']+)[\"']"


#: Words in lower case of which every match of a technology's patterns has one; the patterns of the
#: others are single words already.
WORDS = {
    "React": ("data-react", "__next_data__", "react"), "Next.js": ("__next_data__", "_next/static"), "Nuxt.js": ("__nuxt__", "_nuxt/"), "Vue.js": ("data-v-", "vue."),
    "Angular": ("ng-version", "ng-app", "[ngclass]", "(click)", "angular"), "Svelte": ("svelte",), "Gatsby": ("gatsby",), "Astro": ("astro-",), "WordPress": ("wp-", "wordpress"), "Drupal": ("sites/default/files", "drupal"),
    "Shopify": ("shopify",), "Squarespace": ("squarespace", "sqsp"), "Wix": ("wix",), "Webflow": ("webflow",), "Tailwind CSS": ('class="',), "Bootstrap": ('class="', "bootstrap"),
    "Google Analytics": ("google-analytics", "gtag", "googleanalytics", "ga.js"), "Google Tag Manager": ("googletagmanager", "gtm-"), "Plausible": ("plausible",), "Vercel Analytics": ("vercel",), "Hotjar": ("hotjar", "hj("),
    "jQuery": ("jquery",), "Font Awesome": ("font-awesome", "fontawesome"), "Google Fonts": ("fonts.g",), "reCAPTCHA": ("recaptcha",), "Stripe": ("stripe",), "Intercom": ("intercom",), "Crisp": ("crisp",),
}


def detections(html: Column, headers: Column | None = None) -> Column:
    """Array of (pos, name, category, confidence, source), source telling which kind of pattern
    met first: header, html, meta or script. A pattern is tried only on markup that holds one of
    its words."""
    page = F.struct(html.alias("html"), F.lower(html).alias("low"), *([headers.alias("headers")] if headers is not None else []))
    return let(page, lambda v: _detections(v["html"], v["low"], v["headers"] if headers is not None else None))


def _detections(html: Column, low: Column, headers: Column | None) -> Column:
    made = []
    for pos, (name, category, by_header, markup, generator, scripts) in enumerate(TECHNOLOGIES):
        tests = []
        if headers is not None and by_header:
            met = F.lit(False)
            for key, rx in by_header:
                met = met | F.coalesce(headers[key].rlike(rx), F.lit(False))
            tests.append((met, "header"))
        held = reduce(lambda a, b: a | b, (low.contains(w) for w in WORDS[name])) if name in WORDS else F.lit(True)
        if markup:
            tests.append((held & html.rlike(markup), "html"))
        if generator:
            tests.append((held & F.regexp_extract(html, GENERATOR, 1).rlike(generator), "meta"))
        if scripts:
            tests.append((held & html.rlike(scripts), "script"))
        if not tests:
            continue
        source = None
        for met, kind in tests:
            source = F.when(met, kind) if source is None else source.when(met, kind)
        made.append(F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("name"), F.lit(category).alias("category"), F.lit("high" if by_header else "medium").alias("confidence"), source.alias("source")))
    return F.filter(F.array(*made), lambda d: d["source"].isNotNull())


def detect(pages: DataFrame) -> DataFrame:
    """One row for each technology of the first page of each scan."""
    first = pages.groupBy("scan_id").agg(F.min_by(F.struct("html", "response_headers"), "seq").alias("p"))
    return first.select("scan_id", F.explode(detections(F.col("p.html"), F.col("p.response_headers"))).alias("d")).select("scan_id", "d.*")
