"""Template residue and error-page text in place of content.

The messages of all records (titles and their parts, blocks of a page's own body, notices for browsers
without scripts) are mined for templates with a fixed-depth prefix tree: digits become ``<n>`` or
``<status>``, words without a part in any notice ``<*>``, words of filler Latin ``<lorem>``; the number of
tokens and the first of them are the path, and a leaf holds the templates of one path, in which alike ones
are merged. The tree lies distributed: a path is a shuffle key, a leaf one group.

Each template is classified once, by known phrases or by features (what a notice speaks of, what befell
it, and no word besides that a notice has no use for). A template that is ordinary by itself, with a word
unknown to notices, takes the kind of the leaf's merged template where notices hold most of its messages.
The verdicts go back to the messages by a join on the template, and a record's verdict follows from those
of its messages.

Placeholders nobody filled in are looked for separately, inside ordinary messages too, unless the
sentence speaks about placeholders.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.main_body import HEADINGS, _surroundings, own_blocks
from millrace.llm.page_events import Page, read_page
from millrace.session import cut_lineage, spread

# ---------------------------------------------------------------- fixed values
#: Whole titles (or whole parts of one) that software sets by default, or that stand for no value.
DEFAULTS = (
    "untitled", "untitled document", "untitled page", "untitled <n>", "document", "document <n>", "dokument", "dokument <n>", "new page", "new page <n>",
    "ny side", "ny side <n>", "new document", "nytt dokument", "page title", "title", "tittel", "your title here", "title here", "title goes here", "insert title here", "sample site", "sample page",
    "example page", "example site", "my website", "my web site", "my site", "my blog", "min nettside", "min hjemmeside", "min side", "just another website", "just another site", "just another wordpress site",
    "just another wordpress blog", "default page", "default web site page", "index of", "uten navn", "uten tittel", "no title", "overskrift", "overskrift her", "skriv tittel her", "skriv inn tittel", "skriv inn tittel her",
    "skriv overskrift her", "tittel kommer", "tittel her", "eksempelside", "testside", "test page", "dummy title", "dummy text", "dummytekst", "dummytittel", "null", "undefined", "nan", "object object",
    "hello world", "hei verden", "my wordpress site", "welcome to your new site", "your new site", "react app", "vite app", "vue app", "welcome to nginx", "it works", "apache<n> default page", "coming soon page title",
)
#: Whole messages of errors, refusals and servers.
ERRORS = (
    "<n>", "error", "error <n>", "feil", "feil <n>", "oops", "http <n>", "http error <n>", "http status <n>", "not found", "<n> not found", "page not found", "file not found", "error <n> not found", "<n> page not found", "http status <n> not found",
    "oops that page can t be found", "oops that page cannot be found", "nothing was found at this location", "the page you are looking for could not be found", "the requested url was not found on this server",
    "sorry this page does not exist", "this page does not exist", "siden finnes ikke", "siden finnes ikke lenger", "side ikke funnet", "siden ble ikke funnet", "siden ikke funnet", "fant ikke siden", "vi fant ikke siden", "ikke funnet",
    "beklager siden du leter etter er borte", "siden du leter etter er borte", "siden du leter etter finnes ikke", "adressen kan være feil eller siden kan være flyttet", "forbidden", "<n> forbidden", "error <n> forbidden", "access denied", "ingen tilgang", "ingen tilgang <n>",
    "du har ikke tilgang til denne siden", "du har ikke tilgang til denne siden <n>", "access to this resource on the server is denied", "you don t have permission to access this resource", "unauthorized", "<n> unauthorized", "bad request", "<n> bad request",
    "internal server error", "<n> internal server error", "the server met an unexpected condition and could not complete your request", "the server encountered an internal error", "server error", "server error in application", "object reference not set to an instance of an object",
    "runtime error", "application error", "bad gateway", "<n> bad gateway", "gateway time out", "<n> gateway time out", "gateway timeout", "<n> gateway timeout", "the upstream host did not answer in time", "service unavailable", "<n> service unavailable", "service temporarily unavailable", "<n> service temporarily unavailable",
    "noe gikk galt", "beklager noe gikk galt", "something went wrong", "an error occurred", "det oppsto en feil", "det har oppstått en feil", "feilkode <n>", "feilkode <n> prøv igjen om litt", "prøv igjen om litt", "prøv igjen senere", "try again later",
    "database error", "database connection error", "error establishing a database connection", "kontoen er sperret", "kontoen er stengt", "kontoen er suspendert", "account suspended", "this account has been suspended", "ta kontakt med leverandøren av webhotellet", "contact your hosting provider",
    "nettstedet er utilgjengelig", "siden er utilgjengelig", "tjenesten er utilgjengelig", "siden er under vedlikehold", "site under maintenance", "down for maintenance",
)
#: How messages of errors begin whose rest varies (paths, names of functions).
ERROR_STARTS = ("fatal error", "parse error", "http status <n> the requested resource", "warning include", "warning require", "uncaught error", "uncaught exception", "traceback most recent call last", "index of <*>")
#: Whole messages that scripts are needed or a browser is checked.
SCRIPT_NOTICES = (
    "javascript required", "javascript is required", "javascript is disabled", "javascript er slått av", "please enable javascript", "enable javascript", "enable scripts to continue", "enable javascript to continue", "aktiver skript", "aktiver javascript", "slå på javascript",
    "checking your browser", "checking your browser enable javascript and cookies to continue", "enable javascript and cookies to continue", "just a moment", "vent litt nettleseren kontrolleres", "nettleseren kontrolleres", "you need to enable javascript to run this app",
    "javascript seems to be disabled the shop cannot be shown without it", "please turn on javascript in your browser and reload the page", "sorry this page needs scripting your browser blocks it", "denne siden krever at javascript er slått på", "denne applikasjonen fungerer ikke uten javascript",
    "javascript må være påskrudd for at nettbutikken skal virke", "du må aktivere skript i nettleseren for å se innholdet", "nettleseren din støtter ikke skript eller de er slått av slå på javascript for å gå videre", "your browser does not support javascript",
)
#: How such messages begin whose rest varies.
SCRIPT_STARTS = ("slå på javascript for å se", "enable javascript to", "please enable javascript to", "aktiver javascript for å", "aktiver skript for å", "you need to enable javascript to", "du må slå på javascript for å")
#: Whole messages of filler text.
FILLERS = (
    "dummytekst", "dummytekst dummytekst dummytekst for å vise hvordan avsnittet ser ut", "dette er en eksempeltekst", "dette er en eksempeltekst klikk her for å redigere avsnittet", "eksempeltekst", "klikk her for å redigere", "your headline goes here", "body copy goes here",
    "your headline goes here body copy goes here", "your text here", "your text goes here", "add a short description of your business here", "add a short description of your business here replace this text before you publish", "replace this text before you publish",
    "her skal det stå en kort tekst om bedriften", "her skal det stå en kort tekst om bedriften bytt ut teksten før siden legges ut", "skriv inn din egen tekst her", "skriv inn din egen tekst her fyll på med to til tre setninger om tjenesten", "skriv tekst her", "tekst kommer", "bilde kommer",
    "tekst kommer tekst kommer bilde kommer", "this is a sample paragraph", "this is a sample paragraph double click to edit it and add your own words", "this is sample text", "placeholder text", "sample text", "innhold kommer", "content coming soon",
)
#: Words of filler Latin.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim est laborum porta viverra tempus sodales lacinia facilisi turpis vestibulum neque integer risus gravida pulvinar mauris egestas fermentum ornare vitae ultrices sapien lectus semper vulputate "
    "pellentesque habitant morbi tristique senectus netus malesuada fames suspendisse potenti maecenas faucibus interdum euismod blandit massa cursus mattis molestie iaculis erat hendrerit praesent curabitur donec aliquam bibendum auctor congue nunc etiam phasellus".split()
)
#: Words of sentences that speak about placeholders instead of holding one.
ABOUT_SLOTS = re.compile(r"\b(mal(en|er|ene)?|template(s)?|redaktør(en|er)?|editor|placeholder(s)?|plassholder(en|e)?|settes inn|byttes? ut|bytter|erstattes?|replaced?|variab(el|elen|ler|le|les)|flettefelt|merge field|syntaks|syntax|koden?|snippet)\b", re.I)
_SLOT_NAME = r"(?:[A-Za-zÆØÅæøå_][\w.\- |æøåÆØÅ]*)"
#: Unresolved slots of template languages, mail merges and site builders.
SLOT = re.compile(
    r"\{\{[{%#]?[^{}<>]*\}?\}\}|\{%[^{}<>]*%\}|<%[=\-]?[^<>]*%>|\$\{[^{}<>]*\}|#\{[^{}<>]+\}"
    r"|%%" + _SLOT_NAME + r"%%|%[A-ZÆØÅ][A-ZÆØÅ0-9_]{2,}%|\[\[" + _SLOT_NAME + r"\]\]|@@[\w.]{2,}@@|__[A-ZÆØÅ][A-ZÆØÅ0-9_]*?__(?!\w)|#[A-ZÆØÅ][A-ZÆØÅ0-9_]{2,}#"
    r"|\bXXX_[A-ZÆØÅ0-9_]{2,}\b|«[A-ZÆØÅ][A-ZÆØÅ0-9_]{2,}»"
    r"|\[(?:your|insert|enter|add|sett inn|skriv|fyll|legg|din|ditt|company|firma|navn|name|title|tittel|city|by|sted|adresse|address|telefon|phone|e-?post|e-?mail|dato|date|beskrivelse|description|tekst|text)\b[^\[\]<>]*\]"
    r"|\[(?:firmanavn|bedriftsnavn|selskapsnavn|kundenavn|stedsnavn|sidetittel)\]|\[object Object\]",
    re.I,
)
#: What every slot has a character of; most messages have none.
_SLOT_SIGN = re.compile(r"[{}%\[\]@_#«$]|XXX|xxx")
#: Upper-case only forms of the pattern above, which ignores case for the sake of its word lists.
_UPPER = re.compile(r"^(?:%[^%]|__|#(?!\{)|XXX_|«)")

# Words of notices, by what they say. A message is a notice by its features if it has the features of a
# kind and no word outside the sets that the kind may use (``_by_features``).
_set = lambda words: frozenset(words.split())
#: Words without content of their own ("as" is left out: in titles it mostly is the form of a company).
FUNCTION = _set(
    "en et ei den det de du vi jeg deg dere oss seg er var ble blir blitt har kan kunne må skal vil bør for til av på i inn ut om og eller som ikke ingen noe noen her der denne dette disse nå lenger ennå dessverre beklager ser at å fra hos ved når hvis "
    "vennligst igjen senere litt snart bare men så din ditt dine dere deres vår vårt våre være vært kanskje enten mer med "
    "a an the this that these there you we i it your our is are was were be been being has have had can could cannot t s don doesn couldn isn wasn re ve ll may might must will would should to of on in at for from by with and or but not no its if please again later "
    "sorry unfortunately oops whoops hmm uh oh ooops here now longer anymore any some either currently because akkurat fordi before after back too many mange så such that does do"
)
#: What notices of errors speak of.
SUBJECTS = _set(
    "side siden sida nettside nettsiden nettsida nettstedet nettsted adresse adressen url urlen lenke lenken lenka link linken fil filen fila dokument dokumentet innhold innholdet artikkel artikkelen ressurs ressursen tjeneste tjenesten server serveren tjener tjeneren "
    "konto kontoen domene domenet forespørsel forespørselen database databasen forbindelse forbindelsen page pages site website webpage url link file document content article resource service server account domain request database connection address sesjon sesjonen økt økten session tilkobling tilkoblingen connection origin proxy gateway backend host verten vert forespørsler requests application applikasjon applikasjonen app appen system systemet lenker links bildet image"
)
NEGATIONS = _set("ikke ingen not no cannot t couldn doesn isn unable umulig klarte klarer nothing")
#: What doesn't hold any longer, if negated.
PRESENT = _set(
    "funnet finnes finne finner fant eksisterer eksistere tilgjengelig hentes hente lastes laste vises vise åpnes åpne svarer svarte fullføres fullføre behandles behandle gyldig found find exist exists existing available located reached reach respond responding retrieve retrieved load loaded "
    "display displayed open opened complete completed process processed connect valid locate locating virker virke fungerer fungere work works working responded loading delivered levert leveres"
)
#: What befell a subject.
GONE = _set(
    "slettet fjernet flyttet borte utløpt sperret stengt suspendert utilgjengelig nede deaktivert blokkert avpublisert ugyldig ukjent overbelastet deleted removed moved gone expired suspended disabled unavailable down missing broken blocked unpublished invalid offline overloaded unreachable parkert parked timed lukket closed avbrutt interrupted ended avsluttet failed feilet mislyktes broke exceeded"
)
REFUSALS = _set("denied nektet avvist forbidden forbudt unauthorized unauthorised uautorisert refused rejected")
ACCESS = _set("tilgang adgang tillatelse rettigheter access permission permissions authorized authorised authorization autorisert autorisasjon")
TROUBLE = _set("feil feilen feilmelding error errors exception failure unntak svikt problem trouble troubles issue issues problems problemer vansker difficulties")
HAPPENED = _set("oppsto oppstod oppstått oppstår skjedde skjedd inntraff intern internt uventet teknisk kritisk occurred occured happened encountered internal unexpected unhandled fatal critical technical server serveren database databasen <n> loading lasting tekniske experiencing opplever having uventede ukjent unknown laster lastet")
LOGIN = _set("logg logge logget innlogget pålogget login log logged sign signed")
#: Verbs and helpers of such messages, without weight.
ASIDES = _set(
    "seem seems ser leter letter lette etter leser søker prøver prøvde forsøker forsøkte forsøk ønsker ønsket looking look trying tried try attempted want wanted request requested requesting etterspurte forespurte oppgitte se see view gikk gått galt wrong went go gå tilbake back return forsiden forside startsiden hjem home homepage "
    "kontakt contact administrator administratoren webmaster support kundestøtte brukerstøtte midlertidig permanent temporarily permanently moment øyeblikk http status kode code feilkode code prøv vent wait stavet skrevet sjekk kontroller check typed spelled correctly riktig changed endret name navn under grunnet due "
    "logget logged varslet notified we jobber working saken rette fix fikse løse last refresh reload oppdater søk search new ny nytt våre annet another while få bruke use nettleser nettleseren browser ba bedt om come kom vent slippes sent sendt mangler missing cookies informasjonskapsler maintenance vedlikehold out something required does do"
)
#: What a block that sends the reader on has one of.
GO_ON = _set("gå tilbake forsiden forside startsiden hjem go back return home homepage prøv try igjen again kontakt contact refresh reload oppdater søk search")
SCRIPTS = _set("javascript skript skripting script scripts scripting js")
NEEDS = _set("enable enabled enabling activate activated turn allow requires require required requiring needs need needed disabled off without blocks blocked aktiver aktivere aktivert aktiveres slå slås slått skru skrus skrudd påskrudd avskrudd krever kreves trenger trengs må uten blokkerer blokkert tillat tillate avhengig switch switched kun only off avslått")
SUPPORTED = _set("support supports supported støtte støtter støttes")
SCRIPT_ASIDES = _set("nettbutikk nettbutikken butikken shop store app appen application applikasjon applikasjonen program programmet cookies informasjonskapsler innstillinger innstillingene settings funksjoner functionality features experience fungere fungerer virke virker work works run kjøre kjører vis view show shown properly av på slått turned be full fullt using bruker using continue fortsette videre continue reload refresh page side siden site website before første bare")
TEXTS = _set("tekst teksten tekster text paragraph headline heading overskrift overskriften avsnitt avsnittet beskrivelse beskrivelsen description innhold innholdet content bilde bildet image picture logo tittel title copy setning setningen")
SAMPLES = _set("dummytekst eksempeltekst fylltekst prøvetekst plassholdertekst plassholder placeholder dummy")
SAMPLE_OF = _set("eksempel eksempler sample example prøve")
EDITS = _set("rediger redigere redigér redigeres edit editing bytt byttes bytte erstatt erstatte erstattes replace replaced endre endres change skriv skrive sett settes legg legges insert enter write fyll add goes kommer coming put type edits sett inn legge")
FILLER_ASIDES = _set("klikk klikke dobbeltklikk click double knappen button egen eget egne own words ord kort short bedriften firmaet business company publish publiserer siden side page ut inn body main about mellom tom blank selv yourself deg this dette noe something")
#: Checks that a visitor is no program.
CHECKS = _set("verify verifying verified verifiser verifiserer bekreft bekrefter sjekker sjekkes kontrollerer kontrolleres kontrollert kontroll checking check confirm confirming validating")
HUMANS = _set("menneske mennesket human robot roboter bot bots nettleser nettleseren browser")
#: Words of the standard's names of the statuses 400 to 599.
REASONS = _set(
    "bad request unauthorized payment required forbidden not found method allowed acceptable proxy authentication timeout conflict gone length precondition failed content uri too large long "
    "media type range satisfiable expectation misdirected unprocessable entity locked dependency early upgrade many requests header fields unavailable for legal reasons internal server error "
    "implemented gateway service time out version supported loop detected network backend fetch http status code feil failure access denied"
)
UNNAMED = _set("untitled unnamed navnløs navnløst")
NEW = _set("ny nytt new copy kopi")
#: Of these a new one is no news.
EMPTY = _set("page side dokument document post innlegg")
NOUNS = _set("page side document dokument post innlegg site nettsted nettside website artikkel article")
DEFAULT_ASIDES = _set("uten without tittel title navn name of av <n> without")
#: After these a notice names a path or an address, in whatever words.
NAMING = _set("url urlen fil filen fila file adresse adressen address ressurs ressursen resource page document")

#: Addresses and paths: one variable, whatever words are in them.
_ADDRESS = re.compile(r"(?<!\S)(?:https?://|www\.|/)[^\s/]\S*")
_TOKEN = re.compile(r"[^\W_]+")
_WHOLE = {**dict.fromkeys(DEFAULTS, "default"), **dict.fromkeys(ERRORS, "error"), **dict.fromkeys(SCRIPT_NOTICES, "script"), **dict.fromkeys(FILLERS, "filler")}
_STARTS = [(s, "error") for s in ERROR_STARTS] + [(s, "script") for s in SCRIPT_STARTS]
_ERROR_WORDS = FUNCTION | SUBJECTS | NEGATIONS | PRESENT | GONE | REFUSALS | ACCESS | TROUBLE | HAPPENED | LOGIN | ASIDES
_SCRIPT_WORDS = FUNCTION | SUBJECTS | NEGATIONS | PRESENT | ASIDES | SCRIPTS | NEEDS | SUPPORTED | SCRIPT_ASIDES | CHECKS | HUMANS
_STATUS_WORDS = REASONS | FUNCTION | {"<status>"}
_FILLER_WORDS = FUNCTION | TEXTS | SAMPLES | SAMPLE_OF | EDITS | FILLER_ASIDES
_DEFAULT_WORDS = UNNAMED | NEW | NOUNS | DEFAULT_ASIDES
_VOCABULARY = (
    frozenset(w for phrase in [*_WHOLE, *(s for s, _ in _STARTS)] for w in re.findall(r"[^\W\d_]+", phrase)) | _ERROR_WORDS | _SCRIPT_WORDS | _FILLER_WORDS | _DEFAULT_WORDS | REASONS
) - {"<n>"}
_PART = re.compile(r"\s*\|\s*|\s+[–—·»-]+\s+")


# ---------------------------------------------------------------- the tree
def masked(message: str) -> tuple[str, ...]:
    """Tokens of a message's template."""
    out: list[str] = []
    if "/" in message or "www." in message:
        message = _ADDRESS.sub(" xaddress ", message)
    for w in _TOKEN.findall(message.lower()):
        if w in LOREM:
            t = "<lorem>"
        elif w in _VOCABULARY:
            t = w
        elif len(w) == 3 and w[0] in "45" and w.isdecimal():
            t = "<status>"
        elif any(c.isdigit() for c in w):
            t = "<n>"
        else:
            t = "<*>"
        if t[0] == "<" and out and out[-1] == t and t != "<n>":
            continue  # a run of unknown words is one variable
        if t in ("<n>", "<status>") and out and out[-1] in ("<n>", "<status>"):
            continue
        out.append(t)
    return tuple(out)


def classify(template: tuple[str, ...]) -> str:
    """The verdict on a template: default, error, script, filler, or ordinary."""
    if not template:
        return "ordinary"
    line = " ".join(template).replace("<status>", "<n>")
    if (kind := _WHOLE.get(line)) is not None:
        return kind
    for start, kind in _STARTS:
        if line == start or line.startswith(start + " "):
            return kind
    if template[0] == "<lorem>" and all(t in ("<lorem>", "<n>", "<status>") or (t[0] != "<" and len(t) < 4) for t in template):
        return "filler"
    return _by_features(template)


def _by_features(template: tuple[str, ...]) -> str:
    """The verdict on a template that is no known phrase: that of the first kind whose features it has,
    if all of its words are ones that the kind may use. One variable may stand where a path is named."""
    words = set(template)
    if "<lorem>" in words:
        return "ordinary"
    if "<status>" in words and words <= _STATUS_WORDS and words & REASONS:
        return "error"
    if "<status>" in words:
        words = words - {"<status>"} | {"<n>"}
    if "<*>" in words:
        at = template.index("<*>")
        if template.count("<*>") > 1 or not at or template[at - 1] not in NAMING:
            return "ordinary"
        words.discard("<*>")
        named = True
    else:
        named = False
    if words <= _SCRIPT_WORDS:
        if words & SCRIPTS and (words & NEEDS or words & (SUPPORTED | PRESENT) and (words & NEGATIONS or "bare" in words)):
            return "script"
        if words & CHECKS and words & HUMANS:
            return "script"
        if words & {"cookies", "informasjonskapsler"} and words & {"enable", "enabled", "aktiver", "aktivere", "aktivert", "required", "requires", "krever"}:
            return "script"
    if words <= _ERROR_WORDS:
        subject, negated = words & SUBJECTS, words & NEGATIONS
        if subject and ((negated and words & PRESENT) or words & GONE):
            return "error"
        if named:
            return "ordinary"
        if words & ACCESS and (negated or words & REFUSALS) or (subject and words & REFUSALS):
            return "error"
        if words & TROUBLE and words & HAPPENED and len(words) > 1:
            return "error"
        if subject and len(words) == 2 and words & {"error", "errors", "feil", "feilet", "failure", "failed", "exception"}:
            return "error"
        if words & {"requests", "forespørsler", "connections"} and words & {"many", "mange"}:
            return "error"
        if ("galt" in words and words & {"gikk", "gått"}) or {"went", "wrong"} <= words or {"something", "broke"} <= words:
            return "error"
        if words & ACCESS and words & {"mangler", "missing", "required"}:
            return "error"
        if subject and words & LOGIN and words & {"må", "must", "required", "need", "please", "vennligst"}:
            return "error"
    if named:
        return "ordinary"
    if words <= _FILLER_WORDS and (words & SAMPLES or words & TEXTS and (words & EDITS or words & SAMPLE_OF)):
        return "filler"
    if words <= _DEFAULT_WORDS and (words & UNNAMED or words & NEW and words & EMPTY or (words & {"uten", "without"} and words & {"tittel", "navn", "title", "name"})):
        return "default"
    return "ordinary"


def sends_on(message: str) -> bool:
    """Whether a block only sends the reader on (to the front page, to try again), as below a notice."""
    return _sends_on(masked(message))


def _sends_on(template: tuple[str, ...]) -> bool:
    words = set(template)
    return bool(words & GO_ON) and words <= _ERROR_WORDS


class TemplateTree:
    """Templates under a path of token count and first ``depth`` tokens, each with its verdict and the
    number of messages that had it.

    A tree holds at most ``most`` templates and starts anew beyond that; since verdicts depend on
    templates alone, this changes no verdict (``drain`` hands out the counts before)."""

    def __init__(self, depth: int = 3, most: int = 200_000):
        self.depth, self.most = depth, most
        self.root: dict = {}
        self.size = 0

    def verdict(self, message: str) -> str:
        template = masked(message)
        node = self.root.setdefault(min(len(template), 20), {})
        for t in template[: self.depth]:
            node = node.setdefault(t, {})
        leaf = node.setdefault("", {})
        known = leaf.get(template)
        if known is None:
            if self.size >= self.most:
                self.root, self.size = {}, 0
                return self.verdict(message)
            known = leaf[template] = [classify(template), 0]
            self.size += 1
        known[1] += 1
        return known[0]

    def drain(self) -> list[tuple[str, str, int]]:
        """Template, verdict and count of all that the tree holds; the tree is empty then."""
        out, stack = [], [self.root]
        while stack:
            for key, node in stack.pop().items():
                if key == "":
                    out += [(" ".join(t), verdict, n) for t, (verdict, n) in node.items()]
                else:
                    stack.append(node)
        self.root, self.size = {}, 0
        return out


def holds_slot(message: str) -> bool:
    """Whether a message holds a placeholder nobody filled in and doesn't speak about placeholders."""
    if not _SLOT_SIGN.search(message):
        return False
    for m in SLOT.finditer(message):
        if _UPPER.match(m[0]) and m[0].upper() != m[0]:
            continue
        rest = SLOT.sub(" ", message)
        return not ABOUT_SLOTS.search(rest)
    return False


def block_verdict(message: str, tree: TemplateTree) -> str:
    kind = tree.verdict(message)
    return "filler" if kind == "ordinary" and _latin(message, BODY) else kind


#: Roles of messages: a title or part of one, a block of the own body, a heading of it, the text for browsers
#: without scripts, a block beside the body of a page without headings.
TITLE, BODY, HEADING, HIDDEN, BESIDE = range(5)
#: Kinds of residue that a message can be, and those that stand in place of content.
KINDS, INSTEAD = ("default", "error", "script", "filler"), ("error", "script", "filler")
#: Role, text, and whether a slot in it counts.
Message = tuple[int, str, bool]


def _latin(message: str, role: int) -> bool:
    """Whether nearly all (of a title all) words are filler Latin, which may begin or end with any word."""
    words = _TOKEN.findall(message.lower())
    known = sum(w in LOREM for w in words)
    return len(words) > 1 and known == len(words) if role == TITLE else role != BESIDE and len(words) > 2 and 5 * known >= 4 * len(words)


def title_messages(title: str | None) -> list[Message]:
    """A title, its parts between separators and, of ``name: message``, the message; none for a blank one."""
    if not title or not title.strip():
        return []
    parts = [title, *_PART.split(title)]
    parts += [rest for p in parts if ": " in p for rest in (p.partition(": ")[2], p.rpartition(": ")[2])]
    return [(TITLE, p, not k) for k, p in enumerate(dict.fromkeys(parts))]


def page_messages(page: Page) -> list[Message]:
    """The messages of a page: those of its title, the blocks of its own body in order, the hidden notice of
    a page without a body, and the blocks outside of declared surroundings of a page without a heading."""
    out = title_messages(page.title)
    own = own_blocks(page)
    roles = [HEADING if page.tags[page.owners[i]] in HEADINGS else BODY for i in own]
    out += [(role, page.texts[i], True) for i, role in zip(own, roles, strict=True)]
    if BODY not in roles and page.hidden_notices:
        out.append((HIDDEN, page.hidden_notices, False))
    if HEADING not in roles:
        # Without a heading the body is hard to tell from boxes: a block of its own that is a notice decides.
        aside = _surroundings(page)
        out += [(BESIDE, text, False) for text, owner in zip(page.texts, page.owners, strict=True) if not aside[owner]]
    return out


def decide(messages: list[Message], verdict: Callable[[str], str]) -> str:
    """The verdict on a record by the verdicts on its messages. A slot in the title or the own body, or a
    title's kind, decides. Else what stands in the body instead of content does: all of its blocks are
    notices or only send on, or it has no content and a heading, the hidden notice or a block beside says so."""

    def kind(role: int, text: str) -> str:
        found = verdict(text)
        return "filler" if found == "ordinary" and _latin(text, role) else found

    of = lambda role: [(text, slots) for r, text, slots in messages if r == role]
    first = lambda role, among: next((k for text, _ in of(role) if (k := kind(role, text)) in among), None)
    titled = of(TITLE)
    if any(slots and holds_slot(text) for text, slots in titled):
        return "slot"
    if found := first(TITLE, KINDS):
        return found
    if any(slots and holds_slot(text) for _, text, slots in messages):
        return "slot"
    body = of(BODY)
    instead, aids = None, 0
    for text, _ in body:
        if (k := kind(BODY, text)) != "ordinary":
            instead = instead or k
        elif sends_on(text):
            aids += 1
        else:
            instead = None
            break  # content
    else:
        if instead:
            return instead
    if aids == len(body):
        if found := first(HEADING, INSTEAD):
            return found
        if not body and first(HIDDEN, ("script",)):
            return "script"
    return first(BESIDE, ("error", "script")) or "ordinary"


def title_verdict(title: str | None, tree: TemplateTree) -> str:
    """The verdict on a title; null and blank titles are ordinary."""
    return decide(title_messages(title), tree.verdict)


def page_verdict(page: Page, tree: TemplateTree) -> str:
    """The verdict on a page. A page with content is ordinary, whatever its parts for browsers without
    scripts, comments, scripts and form attributes say."""
    return decide(page_messages(page), tree.verdict)


# ---------------------------------------------------------------- over tables
_tree: TemplateTree | None = None


def worker_tree() -> TemplateTree:
    """The tree of this worker: templates are classified once however many batches and tasks it runs."""
    global _tree
    if _tree is None:
        _tree = TemplateTree()
    return _tree


def is_residue(page: Page) -> bool:
    return page_verdict(page, worker_tree()) != "ordinary"


_MESSAGES = T.ArrayType(T.StructType().add("role", "integer").add("template", "string").add("slot", "boolean").add("latin", "boolean"))


def _records(df: DataFrame, keys: dict[str, Column], value: Column, of: Callable[[str], list[Message]]) -> DataFrame:
    picked = df.select(*[c.alias(k) for k, c in keys.items()], F.xxhash64(value).alias("__doc"), value.alias("__value")).where("__value IS NOT NULL")
    kept = [*keys, "__doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, rows = [0], []
            for text in b.column("__value").to_pylist():
                for role, message, slots in of(text):
                    template = masked(message)
                    rows.append((role, " ".join(template), slots and holds_slot(message), "<lorem>" in template and _latin(message, role)))
                ends.append(len(rows))
            role, template, slot, latin = zip(*rows, strict=True) if rows else ((), (), (), ())
            fields = [pa.array(role, pa.int32()), pa.array(template, pa.string()), pa.array(slot, pa.bool_()), pa.array(latin, pa.bool_())]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["role", "template", "slot", "latin"]))
            yield pa.RecordBatch.from_arrays([b.column(k) for k in kept] + [lists], names=[*kept, "messages"])

    return spread(picked).mapInArrow(run, picked.select(*kept).schema.add("messages", _MESSAGES))


def title_records(df: DataFrame, keys: dict[str, Column], title: Column) -> DataFrame:
    """``keys`` and the masked messages of each non-null title."""
    return _records(df, keys, title, title_messages)


def page_records(df: DataFrame, keys: dict[str, Column], html: Column) -> DataFrame:
    """``keys`` and the masked messages of each non-null page of HTML."""
    return _records(df, keys, html, lambda text: page_messages(read_page(text)))


def alike(a: list[str], b: list[str]) -> float:
    """Share of the places of two templates of one length that hold the same token."""
    return sum(x == y for x, y in zip(a, b, strict=True)) / len(a) if a else 1.0


def merge_templates(counts: list[tuple[str, int]], least: float = 0.6) -> list[tuple[str, list[tuple[str, int]]]]:
    """Templates of one length merged by similarity, each merged template with its members: the most
    frequent first, each joins the merged template most like it, if at least ``least``, and places that
    differ become ``<*>``. The result doesn't depend on the order of ``counts``."""
    merged: list[tuple[list[str], list[tuple[str, int]]]] = []
    for template, n in sorted(counts, key=lambda c: (-c[1], c[0])):
        tokens = template.split()
        best = max(merged, key=lambda m: alike(m[0], tokens), default=None)
        if best is not None and alike(best[0], tokens) >= least:
            best[0][:] = [x if x == y else "<*>" for x, y in zip(best[0], tokens, strict=True)]
            best[1].append((template, n))
        else:
            merged.append((tokens, [(template, n)]))
    return [(" ".join(tokens), members) for tokens, members in merged]


def leaf_verdicts(counts: list[tuple[str, int]], least: float = 0.75, most: float = 0.8) -> list[tuple[str, str, str, int]]:
    """``template, merged, verdict, n`` of the templates of a leaf. A member that is ordinary by itself takes
    the kind that at least ``most`` of the messages of its merged template have, if two members or more
    have it: one word that notices don't know makes no content."""
    out = []
    for merged, members in merge_templates(counts, least):
        own = {t: classify(tuple(t.split())) for t, _ in members}
        by_kind: dict[str, list[int]] = {}
        for t, n in members:
            by_kind.setdefault(own[t], []).append(n)
        total = sum(n for _, n in members)
        taken = next((k for k, ns in sorted(by_kind.items()) if k != "ordinary" and len(ns) > 1 and sum(ns) >= most * total), "ordinary")
        out += [(t, merged, taken if own[t] == "ordinary" else own[t], n) for t, n in members]
    return out


_TEMPLATE = "template string, merged string, verdict string, aid boolean, n bigint"


def counted_templates(records: DataFrame, depth: int = 3, beside: bool = True) -> DataFrame:
    """``template, n, length, path`` of all messages of ``records`` (or of all but those ``beside`` bodies);
    counted before they are shuffled."""
    messages = records.select(F.explode("messages").alias("m")).where(F.lit(beside) | (F.col("m.role") != BESIDE))
    tokens = F.split("template", " ")
    counted = messages.groupBy("m.template").agg(F.count("*").alias("n"))
    return counted.withColumn("length", F.size(tokens)).withColumn("path", F.concat_ws(" ", F.slice(tokens, 1, depth)))


def _classified(templates: DataFrame) -> DataFrame:
    """``templates`` with ``verdict`` and ``aid`` (only sends on), each template by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = [tuple(t.split()) for t in b.column("template").to_pylist()]
            made = [pa.array([classify(t) for t in of], pa.string()), pa.array([_sends_on(t) for t in of], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "verdict", "aid"])

    return templates.mapInArrow(run, T.StructType(list(templates.schema.fields)).add("verdict", "string").add("aid", "boolean"))


def _leaves(templates: DataFrame, slice_size: int = 2000) -> DataFrame:
    """The leaves of the tree, merged and classified. A path with more than ``slice_size`` templates is taken
    in slices by hash, so that no task holds more than about that many."""
    sizes = templates.groupBy("length", "path").agg(F.ceil(F.count("*") / slice_size).alias("slices"))
    sliced = templates.join(sizes, ["length", "path"]).withColumn("slice", F.pmod(F.xxhash64("template"), F.col("slices")))

    def merge(table: pa.Table) -> pa.Table:
        out = leaf_verdicts(list(zip(table.column("template").to_pylist(), table.column("n").to_pylist(), strict=True)))
        t, m, v, n = zip(*out, strict=True)
        return pa.table({"template": pa.array(t, pa.string()), "merged": pa.array(m, pa.string()), "verdict": pa.array(v, pa.string()), "aid": pa.array([_sends_on(tuple(x.split())) for x in t], pa.bool_()), "n": pa.array(n, pa.int64())})

    return sliced.select("length", "path", "slice", "template", "n").groupBy("length", "path", "slice").applyInArrow(merge, _TEMPLATE)


def template_verdicts(records: DataFrame) -> DataFrame:
    """``template, verdict, aid`` of the templates that are no content. Only leaves with a notice, or with a
    message that sends on, are merged: in others nothing can be taken over."""
    templates = cut_lineage(_classified(counted_templates(records)))
    noticed = templates.where("verdict != 'ordinary' OR aid").select("length", "path").distinct()
    merged = _leaves(templates.drop("verdict", "aid").join(noticed, ["length", "path"], "left_semi"))
    return merged.where("verdict != 'ordinary' OR aid").select("template", "verdict", "aid")


def record_verdicts(records: DataFrame, keys: Sequence[str], broadcast_bytes: int = 8_000_000) -> DataFrame:
    """``keys`` and ``verdict`` of ``records`` (of ``title_records`` or ``page_records``): default, error,
    script, filler, slot or ordinary. A record delivered twice is one; records that share their keys but not
    their content have a row each.

    ``records`` is read twice: pass a written table. The verdicts on templates are joined by broadcast if they
    take at most ``broadcast_bytes``, else by shuffle; a message's row goes back to its record map-side."""
    verdicts = cut_lineage(template_verdicts(records))
    size = verdicts.agg(F.coalesce(F.sum(F.length("template") + 40), F.lit(0))).first()[0]
    of = [*keys, "__doc"]
    rows = records.select(*of, F.posexplode_outer("messages").alias("pos", "m")).select(*of, "pos", "m.*")
    rows = rows.join(F.broadcast(verdicts) if size <= broadcast_bytes else verdicts, "template", "left")
    role = F.col("role")
    known = F.coalesce("verdict", F.lit("ordinary"))
    kind = F.when((known == "ordinary") & F.col("latin"), "filler").otherwise(known)
    notice = kind != "ordinary"
    first = lambda test: F.min(F.when(test & notice, F.struct("pos", kind.alias("kind"))))["kind"]
    rows = rows.groupBy(*of).agg(
        F.bool_or((role == TITLE) & F.col("slot")).alias("title_slot"), first(role == TITLE).alias("titled"), F.bool_or("slot").alias("any_slot"),
        F.count_if(role == BODY).alias("body"), F.count_if((role == BODY) & notice).alias("notices"), F.count_if((role == BODY) & ~notice & F.coalesce("aid", F.lit(False))).alias("aids"),
        first(role == BODY).alias("instead"), first((role == HEADING) & kind.isin(*INSTEAD)).alias("headed"), first((role == HIDDEN) & (kind == "script")).alias("hidden"), first((role == BESIDE) & kind.isin("error", "script")).alias("beside"),
    )
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    all_aids = F.col("aids") == F.col("body")
    verdict = (
        F.when(true("title_slot"), "slot").when(F.col("titled").isNotNull(), F.col("titled")).when(true("any_slot"), "slot")
        .when((F.col("notices") > 0) & (F.col("notices") + F.col("aids") == F.col("body")), F.col("instead"))
        .when(all_aids & F.col("headed").isNotNull(), F.col("headed")).when(all_aids & (F.col("body") == 0) & F.col("hidden").isNotNull(), F.col("hidden"))
        .otherwise(F.coalesce("beside", F.lit("ordinary")))
    )
    return rows.select(*keys, verdict.alias("verdict"))


def mined_templates(records: DataFrame, slice_size: int = 2000) -> DataFrame:
    """``template, verdict, n_messages``: all merged templates of ``records`` by verdict, with how many
    messages they have; blocks beside the body don't count. The result doesn't depend on the partitions."""
    merged = _leaves(cut_lineage(counted_templates(records, beside=False)), slice_size)
    return merged.groupBy(F.col("merged").alias("template"), "verdict").agg(F.sum("n").alias("n_messages"))
