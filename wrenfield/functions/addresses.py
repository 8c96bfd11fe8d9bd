"""Hosts of web and mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HOST = r"^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$"


def host_of(url: Column) -> Column:
    """The bare host of a web address in lower case, without ``www.``; null where there is none."""
    host = F.regexp_replace(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?(?://)?(?:[^/?#@\s]*@)?(?:www\.)?([^/?#:\s]*).*$", "$1")
    return F.when(host.rlike(_HOST), host)


def mail_of(address: Column) -> Column:
    """A mail address, trimmed and in lower case, without ``mailto:``; null where it is none."""
    mail = F.regexp_replace(F.lower(F.trim(address)), r"^mailto:", "")
    return F.when(mail.rlike(r"^[a-z0-9._%+'-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*\.[a-z]{2,}$"), mail)


def mail_host_of(address: Column) -> Column:
    return F.regexp_extract(mail_of(address), r"@(?:www\.)?(.*)$", 1)
