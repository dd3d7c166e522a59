"""Names of people in headers: normal form, tokens, and whether a header names a person at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains, words and patterns that results depend on.
FREEMAIL = (
    "gmail.com", "googlemail.com", "gmx.de", "gmx.net", "gmx.at", "gmx.ch", "web.de", "t-online.de", "freenet.de", "posteo.de", "mailbox.org", "outlook.com", "outlook.de", "hotmail.com", "hotmail.de", "live.com", "live.de",
    "msn.com", "icloud.com", "me.com", "mac.com", "yahoo.com", "yahoo.de", "aol.com", "aol.de", "arcor.de", "online.de", "proton.me", "protonmail.com", "kabelmail.de", "vodafone.de", "email.de", "mail.de",
)
ROLES = (
    "no-?reply", "do-?not-?reply", "donotreply", "noreply", "info", "newsletters?", "news", "service", "services", "support", "kontakt", "contact", "hello", "hallo", "team", "mail", "mailer", "notifications?", "notify",
    "benachrichtigung(en)?", "rechnung(en)?", "billing", "invoices?", "orders?", "bestellung(en)?", "versand", "shipping", "shipment", "account", "accounts", "security", "sicherheit", "alerts?", "updates?", "marketing",
    "presse", "press", "jobs", "karriere", "careers", "feedback", "help", "hilfe", "admin", "webmaster", "postmaster", "mailer-daemon", "bounces?", "reply", "antwort", "kundenservice", "customerservice", "crm", "events?",
    "community", "digest", "calendar-notification", "auto-?confirm", "confirm", "verify", "receipts?", "payments?", "zahlung(en)?", "buchung(en)?", "booking", "reservations?", "tickets?", "status", "system",
)
ORGANISATIONS = (
    "gmbh", "ag", "kg", "ohg", r"e\.\s?v\.?", "ev", "ug", "se", "inc", "ltd", "llc", "corp", "co", "team", "service", "services", "support", "newsletter", "news", "info", "shop", "store", "bank", "sparkasse", "volksbank",
    "versicherung", "verlag", "online", "club", "verein", "kundenservice", "noreply", "no-reply", "portal", "app", "community", "stiftung", "amt", "stadt", "gemeinde", "praxis", "kanzlei", "hotel", "airlines?", "official", "offiziell",
)
PARTICLES = ("von", "van", "der", "den", "de", "del", "di", "da", "du", "la", "le", "zu", "zum", "zur", "ten", "ter", "vom")
TITLE = r"herrn?|frau|dr\.?|prof\.?|mr\.?|mrs\.?|ms\.?|dipl\.-?\w*\.?"
TOKEN = r"[^\W\d_][^\W\d_'’\-]*(?:[-'’][^\W\d_]+)*"
MIN_TOKEN = 3

ROLE_PATTERN = rf"({'|'.join(ROLES)})([.\-_+].*)?"
ORGANISATION_PATTERN = rf"(\b({'|'.join(ORGANISATIONS)})\b|[.@&|/:])"


def bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")


def normalize_name(name: Column) -> Column:
    """``Last, First`` becomes ``First Last`` if there is exactly one comma with something on both sides."""
    n = bare(name)
    parts = F.split(n, ",", -1)
    last, first = F.trim(parts[0]), F.trim(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & (last != "") & (first != ""), F.concat_ws(" ", first, last)).otherwise(n)


def strip_titles(name: Column) -> Column:
    return F.regexp_replace(bare(name), rf"(?iU)^(?:(?:{TITLE})\s+)+", "")


def _words(name: Column) -> Column:
    return F.regexp_extract_all(strip_titles(name), F.lit(f"(?U){TOKEN}"), F.lit(0))


def name_tokens(name: Column) -> Column:
    """Lower-case parts of a name of three characters or more, without titles and particles."""
    return F.transform(F.filter(_words(name), lambda t: (F.length(t) >= MIN_TOKEN) & ~F.lower(t).isin(*PARTICLES)), lambda t: F.lower(t))


def is_role(local: Column) -> Column:
    return F.lower(local).rlike(f"^(?:{ROLE_PATTERN})$")


def is_freemail(domain: Column) -> Column:
    return domain.isin(*FREEMAIL)


def looks_like_person(name: Column, addr: Column) -> Column:
    """Does a display name with this address name a person rather than a service or company?"""
    n = normalize_name(F.coalesce(name, F.lit("")))
    words = _words(n)
    local, domain = F.substring_index(addr, "@", 1), F.when(F.instr(addr, "@") > 0, F.substring(addr, F.instr(addr, "@") + 1, F.length(addr))).otherwise("")
    proper = F.forall(words, lambda t: F.lower(t).isin(*PARTICLES) | F.substring(t, 1, 1).rlike(r"^\p{Lu}"))
    shaped = (n != "") & ~n.rlike(r"(?U)\d") & ~n.rlike(f"(?iU){ORGANISATION_PATTERN}") & F.size(words).between(1, 4) & proper
    own = F.exists(words, lambda t: (F.length(t) >= MIN_TOKEN) & F.contains(F.lower(local), F.lower(t)))
    return F.coalesce(shaped & (is_freemail(domain) | (~is_role(local) & (own | (F.size(words) >= 2)))), F.lit(False))
