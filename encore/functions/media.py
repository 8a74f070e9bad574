"""Media groups of attribution events."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .aggregates import as_col

# Event type lists and prefixes of each media group.
DIRECT_EVENT = "MANUAL_ENTRY"
CRM_EVENTS = (
    "EMAIL", "COM_EMAIL", "PUSH", "COM_PUSH", "WEB_PUSH", "COM_WHATSAPP", "SEM_WHATSAPP",
    "SOCIAL_WHATSAPP", "ERROR_EMAIL", "ERROR_PUSH", "ERROR_WEB_PUSH",
)
METASEARCH_EVENTS = (
    "SEM_SKYSCANNER", "SEM_TRIVAGO", "SEM_TRIPADVISOR", "SEM_TURISMOCITY", "SEM_METASEARCH",
    "SEM_KAYAK", "SEM_MUNDI", "SEM_HOTELS", "SEM_HOTELS_COMBINED", "SEO_GOOGLE_FLIGHTS",
    "SEO_GOOGLE_HOTELS", "ERROR_SEM_SKYSCANNER", "ERROR_SEM_TRIVAGO", "ERROR_SEM_TRIPADVISOR",
    "ERROR_SEM_METASEARCH", "ERROR_SEM_KAYAK", "ERROR_SEM_MUNDI", "ERROR_SEM_HOTELS",
    "ERROR_SEM_HOTELS_COMBINED",
)
SEARCH_PREFIXES = ("SEO_", "SEM_", "BND_", "ERROR_SEM_")

PATH_LABELS = {
    "direct": "DIRECTO",
    "crm": "CRM",
    "metasearch": "METABUSCADORES",
    "search": "SEM/SEO/KWBRAND",
    "other": "OTROS",
}
CLICK_LABELS = {
    "direct": "Directo",
    "crm": "CRM",
    "metasearch": "Metabuscadores",
    "search": "SEM/SEO/KWBrand",
    "other": "Otros",
}


def media_group(event: str | Column, labels: Mapping[str, str] = PATH_LABELS) -> Column:
    """Group of an event type; lists are tested before prefixes, and a prefix's '_' is literal."""
    event = as_col(event)
    is_search = F.lit(False)
    for prefix in SEARCH_PREFIXES:
        is_search = is_search | event.startswith(prefix)
    return (
        F.when(event == DIRECT_EVENT, labels["direct"])
        .when(event.isin(*CRM_EVENTS), labels["crm"])
        .when(event.isin(*METASEARCH_EVENTS), labels["metasearch"])
        .when(is_search, labels["search"])
        .otherwise(labels["other"])
    )


def event_taxonomy(event: str | Column) -> Column:
    """As :func:`media_group` with report labels; a missing event stays null."""
    event = as_col(event)
    return F.when(event.isNotNull(), media_group(event, CLICK_LABELS))
