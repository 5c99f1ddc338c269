"""Claims: short statements taken out of texts, their kind, topics and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What marks a secret, and kinds of claims in the order in which they are tried.
SECRET = r"(?i)(sk-[A-Za-z0-9_-]{10,}|sha256~[A-Za-z0-9_-]{10,}|Bearer\s+[A-Za-z0-9_.-]{20,}|password\s*[:=]\s*\S+)"
RULE = r"(?i)\b(must|never|always|do not|don't|stop doing|explicitly rejected|only within|requires?|forbidden|prohibited)\b"
PREFERENCE = r"(?i)\b(prefers?|wants?|user explicitly|user's? (?:established|preferred)|the user (?:wants|likes|prefers))\b"
DECISION = r"(?i)\b(pivot|reframed as|consolidating|strategic decision|switched to|migrated? to|chose|selected|adopted)\b"
CAVEAT = r"(?i)\b(needs work|plateaued|waiting for|NOT available|not deployed|placeholder|estimated|TODO|FIXME|blocked|pending)\b"
FIGURE = r"\d+[%KMGkmg]|\d+\.\d+|[\$€£]\d+|\d+/\d+"
SEVERITY = {"rule": "critical", "preference": "high", "decision": "high", "fact": "medium", "caveat": "low"}


def split(docs: DataFrame, key: str = "doc_id", least: int = 20) -> DataFrame:
    """A row for each line of the texts with at least `least` characters that isn't sensitive: key, pos, claim."""
    lines = docs.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "claim")).withColumn("claim", F.trim("claim"))
    return lines.where((F.length("claim") >= least) & ~F.col("claim").rlike(SECRET))


def kind(text: Column, source: Column | str = "note") -> Column:
    source = source if isinstance(source, Column) else F.lit(source)
    feedback = source == "feedback"
    return F.when(feedback & text.rlike(RULE), "rule").when(text.rlike(PREFERENCE), "preference").when(text.rlike(DECISION), "decision").when(text.rlike(CAVEAT), "caveat").when(feedback, "rule").when(source == "reference", "fact").when(text.rlike(FIGURE), "fact").when(text.rlike(RULE), "rule").otherwise("fact")


def severity(kind_: Column) -> Column:
    found = F
    for name, value in SEVERITY.items():
        found = found.when(kind_ == name, F.lit(value))
    return found.otherwise("info")


def exact_hash(text: Column) -> Column:
    """Of the text in lower case with white space as one space."""
    return F.substring(F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256), 1, 16)


def near_hashed(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with near_hash: of the set of the text's word triples, each sorted, so that another order of neighbours is the
    same; texts with fewer than three words by their exact hash. Words are a column first: within a lambda an expression
    would be worked out for each element."""
    worded = rows.withColumn("_words", F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))
    words = F.col("_words")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 2, F.lit(1))), lambda k: F.array_join(F.array_sort(F.slice(words, k, F.lit(3))), " "))
    found = F.when(F.size(words) >= 3, F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(triples)), ","), 256), 1, 16)).otherwise(exact_hash(F.col(text)))
    return worded.withColumn("near_hash", found).drop("_words")


def topics(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that the text matches."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in sorted(patterns.items()))))


# ---------------------------------------------------------------- notes in markdown

_BOLD = r"(?s)\*\*([^*]+):\*\*\s*(.*?)(?=\n\*\*[^*]+:\*\*|\z)"
_BULLET = r"(?m)^\s*[-*]\s+(.+)"
_ROW = r"(?m)^\|(.+)\|$"
_LINK = r"\[\[([^\]]+)\]\]"
#: Words in brackets are regular expressions as they stand; fixed values.
TOPICS = {
    "methodology": r"(?i)\b(TDD|BDD|CDD|EDD|CBT|rubric|red.green|validation.matrix|contracts?.first|tests?.first)\b",
    "granite_xeon": r"(?i)\b(granite|xeon|cpu.infer|intel.xeon|racmaas)\b",
    "self_contained": r"(?i)\b(self.contained|no.docker|no.external|no.separate.frontend|sqlite.not.postgres)\b",
    "terse_prompts": r"(?i)\b(terse|one.word.only|short.prompt|less.is.more|prompt.tuning)\b",
    "fail_safe": r"(?i)\b(over.escalat|safe.failure|never.dismiss|fail.open|dangerous.miss)\b",
    "no_auto_remediate": r"(?i)\b(observe.everything|suggest.for|act.only|no.auto.remediat|never.auto)\b",
    "deterministic": r"(?i)\b(temperature.0|temp.0|deterministic|reproducib|same.input.same.output)\b",
    "cascade_framework": r"(?i)\b(domain.pack|framework.unchanged|zero.framework|no.engine.change|domain.agnostic)\b",
    "production_gates": r"(?i)\b(earn.the.right|measurable.gate|production.gate|red.to.gold|green.light)\b",
    "target_cluster_only": r"(?i)\b(target.cluster|wrong.cluster|context.drift|use.context)\b",
    "openshift_deploy": r"(?i)\b(openshift|ocp|deploy.to|deployed.on|namespace|oc\s+(?:get|exec|apply|login))\b",
    "immutable_ledger": r"(?i)\b(immutable.ledger|hash.chain|append.only|decision.record|audit.verdict)\b",
    "demo_platform": r"(?i)\b(demo.platform|rhdp|showroom|catalog.item|sandbox.api|agnosticv)\b",
    "summit_connect": r"(?i)\b(summit.connect|summit.2026|event.lab|quickstart)\b",
    "pipeline_routing": r"(?i)\b(routing.engine|inference.routing|model.select|lane.routing|corpora)\b",
    "agent_architecture": r"(?i)\b(multi.agent|agent.promot|agent.discover|nano.agent|micro.agent|macro.agent)\b",
    "testing_coverage": r"(?i)\b(\d+\s*tests?|test.suite|test.pass|make\s+test|pytest)\b",
    "maas_inference": r"(?i)\b(maas|litellm|vllm|llama.cpp|model.serv)\b",
    "governance": r"(?i)\b(gcl|governed.cognitive|falsif|audit.loop|governance)\b",
    "intel_partnership": r"(?i)\b(intel.partner|fsi|financial.service|card.issuer)\b",
    "oauth_security": r"(?i)\b(oauth.proxy|ose.oauth|bearer.token|sso.token|security.compliance|tls.verif)\b",
    "branding": r"(?i)\b(powered.by.intel|intel.xeon.6|no.gaudi|brand|logo.svg|red.hat.logo)\b",
    "story_first": r"(?i)\b(business.solution|story.experience|act.based|hero.s.journey|progressive.disclosure|projection.scale)\b",
    "no_auto_action": r"(?i)\b(no.auto.remediat|pending.action|never.approved|observe.everything|suggest.for|read.only.diagnostic)\b",
    "claim_registry": r"(?i)\b(claim.registr|validation.matrix|every.factual.claim|benchmark.proof)\b",
    "self_serve_quickstart": r"(?i)\b(quickstart|self.serve|hands.on|build.understanding|user.constructs|liftoff|onboard)\b",
    "svg_rendering": r"(?i)\b(svg|inline.fill|css.class|viewbox|defs.style)\b",
}


def note_claims(notes: DataFrame, key: str, body: str = "body") -> DataFrame:
    """key, claim, section of notes in markdown: rows of tables, bullets, paragraphs of more than 15 characters without
    their links (section opening), and what stands under bold headings, by bullet where there are any. Code blocks, rules
    of tables and what is sensitive are left out; of headings that repeat the last one counts."""
    text, bare = F.col(body), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    all_of = lambda c, form, group: F.regexp_extract_all(c, F.lit(form), F.lit(group))
    claim = lambda c, section: F.struct(bare(c).alias("claim"), section.alias("section"))
    none = F.array().cast("array<struct<claim:string,section:string>>")

    def cells(row: Column) -> Column:
        return F.filter(F.transform(F.split(row, r"\|"), bare), lambda c: c != "")

    def of_paragraph(p: Column) -> Column:
        rows = F.filter(F.transform(all_of(p, _ROW, 1), cells), lambda r: (F.size(r) > 0) & ~F.forall(r, lambda c: F.startswith(c, F.lit("-"))))
        plain = bare(F.regexp_replace(p, _LINK, ""))
        return (
            F.when(F.startswith(p, F.lit("|")) & F.contains(F.substring(p, 2, 1 << 30), F.lit("|")), F.transform(rows, lambda r: claim(F.array_join(r, " | "), F.lit("table"))))
            .when(F.startswith(p, F.lit("```")), none)
            .when(p.rlike(r"^[-*] "), F.transform(all_of(p, _BULLET, 1), lambda b: claim(b, F.lit("body"))))
            .when(F.length(plain) > 15, F.array(claim(plain, F.lit("opening"))))
            .otherwise(none)
        )

    def of_section(s: Column) -> Column:
        bullets, name = all_of(s["text"], _BULLET, 1), F.lower(bare(s["name"]))
        return F.when(bare(s["text"]) == "", none).when(F.size(bullets) > 0, F.transform(bullets, lambda b: claim(b, name))).otherwise(F.array(claim(s["text"], name)))

    heads = F.arrays_zip(all_of(text, _BOLD, 1).alias("name"), all_of(text, _BOLD, 2).alias("text"))
    parts = notes.select(key, F.filter(F.transform(F.split(bare(F.regexp_replace(text, _BOLD, "")), "\n\n"), bare), lambda p: p != "").alias("_p"), heads.alias("_h"))
    last = F.filter("_h", lambda s, k: ~F.exists(F.slice("_h", k + 2, F.greatest(F.size("_h") - k - 1, F.lit(0))), lambda t: t["name"] == s["name"]))
    found = F.concat(F.flatten(F.transform("_p", of_paragraph)), F.flatten(F.transform(last, of_section)))
    return parts.select(key, F.explode(found).alias("c")).select(key, "c.claim", "c.section").where(~F.col("claim").rlike(SECRET))
