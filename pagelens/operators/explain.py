"""What a finding code means and what to do, in our own words, as a small table to join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions.text import title_of

#: code -> (title, what to do); codes that are not listed get theirs from a pattern.
TEXTS = {
    "incomplete-probe": ("Response did not finish", "Find out why the server stopped or the limit was reached, then run again."),
    "status-mismatch": ("Unexpected status", "Serve the page with a status that its contract allows."),
    "final-url-mismatch": ("Unexpected final address", "Correct the redirect, or the expected address."),
    "missing-title": ("No title", "Render a title in the head on the server."),
    "missing-description": ("No description", "Render a description in the head."),
    "missing-canonical": ("No canonical link", "Render one absolute canonical link."),
    "missing-h1": ("No main heading", "Render the heading on the server."),
    "missing-main-text": ("No main text", "Render the text of the main element on the server."),
    "robots-header-noindex": ("Header forbids indexing", "Remove the directive from the response header."),
    "robots-header-restrictive": ("Header restricts crawlers", "Keep only the restrictions that are meant for this page."),
    "robots-header-ineffective": ("Header has no effect", "Lift the page's own noindex, or drop the permission from the header."),
    "multiple-robots": ("Directives in several elements", "Put all directives for one crawler into one element."),
    "robots-txt-disallowed": ("Crawling is disallowed", "Allow the path in robots.txt."),
    "robots-txt-unavailable": ("robots.txt unreadable", "Serve robots.txt with a definite answer."),
    "robots-txt-conflict": ("robots.txt and page disagree", "Decide in one place whether the page may be found."),
    "missing-open-graph-metadata": ("Link preview incomplete", "Render the listed Open Graph fields."),
    "missing-twitter-card-metadata": ("Card incomplete", "Render the listed card fields or their fallbacks."),
    "invalid-social-metadata-url": ("Preview address not absolute", "Write the whole http(s) address."),
    "invalid-json-ld": ("Structured data broken", "Correct the JSON."),
    "json-ld-analysis-limit": ("Structured data too large", "Send less of it."),
    "head-metadata-in-body": ("Metadata too late", "Send metadata before the head ends."),
    "slow-first-byte": ("Slow first byte", "Send the head before slow work is done."),
    "slow-critical-signals": ("Slow required signals", "Stream required content earlier."),
    "response-instability": ("Responses vary", "Look for caches or servers that disagree."),
    "stream-instability": ("Documents vary", "Make repeated responses equal."),
    "content-encoding-ignored": ("Encoding not negotiated", "Honour the request's accepted encodings."),
    "waiver-expired": ("Waiver expired", "Renew it or solve its cause."),
    "waiver-unused": ("Waiver unused", "Delete it."),
}
#: Codes whose remedy has a snippet, and its theme.
THEMES = {
    "missing-title": "head", "missing-description": "head", "missing-canonical": "head", "head-metadata-in-body": "head",
    "missing-open-graph-metadata": "social", "missing-twitter-card-metadata": "social",
    "missing-h1": "content", "missing-main-text": "content",
}
#: Each framework's own way to render metadata, link previews and content on the server, by theme.
SNIPPETS = {
    "nextjs": {"head": "export const metadata = { title, description, alternates: { canonical } }", "social": "export const metadata = { openGraph: { title, type, url, images }, twitter: { card } }", "content": "export default async function Page() { const data = await load(); return <main><h1>{data.title}</h1></main> }"},
    "nuxt": {"head": "useSeoMeta({ title, description }); useHead({ link: [{ rel: 'canonical', href }] })", "social": "useSeoMeta({ ogTitle, ogType, ogUrl, ogImage, twitterCard })", "content": "const { data } = await useAsyncData('page', load)"},
    "astro": {"head": "<title>{title}</title><meta name='description' content={description}><link rel='canonical' href={url}>", "social": "<meta property='og:image' content={new URL(image, Astro.site)}>", "content": "--- const page = await load(); --- <main><h1>{page.title}</h1></main>"},
    "sveltekit": {"head": "<svelte:head><title>{title}</title><link rel='canonical' {href}></svelte:head>", "social": "<svelte:head><meta property='og:title' content={title}></svelte:head>", "content": "export const load = async () => ({ page: await fetchPage() })"},
    "remix": {"head": "export const meta = () => [{ title }, { name: 'description', content }]", "social": "export const meta = () => [{ property: 'og:title', content: title }]", "content": "export const loader = async () => json(await page())"},
    "laravel": {"head": "<title>{{ $title }}</title><link rel=\"canonical\" href=\"{{ url()->current() }}\">", "social": "<meta property=\"og:title\" content=\"{{ $title }}\">", "content": "return view('page', ['page' => $page]);"},
    "wordpress": {"head": "add_theme_support('title-tag');", "social": "add_action('wp_head', 'theme_preview_tags');", "content": "<main><h1><?php the_title(); ?></h1><?php the_content(); ?></main>"},
    "php": {"head": "<title><?= htmlspecialchars($title) ?></title>", "social": "<meta property=\"og:title\" content=\"<?= htmlspecialchars($title) ?>\">", "content": "<main><h1><?= htmlspecialchars($title) ?></h1></main>"},
}


def explanations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t, d) for c, (t, d) in TEXTS.items()], "code string, title string, remedy string")


def explained(findings: DataFrame, framework: str | None = None) -> DataFrame:
    """Findings with title, remedy and, for codes with a theme, the framework's snippet."""
    known = explanations(findings.sparkSession)  # as many rows as there are codes above
    title = F.when(F.col("code").startswith("duplicate-"), "Given more than once").when(F.col("code").startswith("conflicting-"), "Values disagree").when(F.col("code").endswith("-drift"), "Agents are answered differently")
    remedy = F.when(F.col("code").rlike("^(duplicate|conflicting)-"), "Keep one.").when(F.col("code").endswith("-drift"), "Answer all agents alike.").otherwise("Look at the evidence.")
    snippet = F.lit(None).cast("string")
    for theme, text in SNIPPETS.get(framework or "", {}).items():
        snippet = F.when(F.col("code").isin(*[c for c, t in THEMES.items() if t == theme]), text).otherwise(snippet)
    return findings.join(known, "code", "left").withColumn("title", F.coalesce("title", title, title_of(F.col("code")))).withColumn("remedy", F.coalesce("remedy", remedy)).withColumn("snippet", snippet)
