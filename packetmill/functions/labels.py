"""Attack label to macro class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The macro class of each label.
LABEL_CLASSES = {
    "normal": "Normal",
    "neptune": "DoS", "back": "DoS", "land": "DoS", "pod": "DoS", "smurf": "DoS", "teardrop": "DoS",
    "mailbomb": "DoS", "apache2": "DoS", "processtable": "DoS", "udpstorm": "DoS",
    "ipsweep": "Probe", "nmap": "Probe", "portsweep": "Probe", "satan": "Probe", "mscan": "Probe",
    "saint": "Probe",
    "ftp_write": "R2L", "guess_passwd": "R2L", "imap": "R2L", "multihop": "R2L", "phf": "R2L", "spy": "R2L",
    "warezclient": "R2L", "warezmaster": "R2L", "sendmail": "R2L", "named": "R2L", "snmpgetattack": "R2L",
    "snmpguess": "R2L", "xlock": "R2L", "xsnoop": "R2L", "worm": "R2L",
    "buffer_overflow": "U2R", "loadmodule": "U2R", "perl": "U2R", "rootkit": "U2R", "httptunnel": "U2R",
    "ps": "U2R", "sqlattack": "U2R", "xterm": "U2R",
}


def clean_label(label: Column) -> Column:
    """Strip white space, lower the case, drop trailing dots."""
    bare = F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))
    return F.regexp_replace(bare, r"\.+$", "")


def macro_class(label: Column) -> Column:
    """Class of a raw label; unknown labels count as Normal.

    Forty literals are cheaper as a constant map inside the projection than as a join.
    """
    pairs = [F.lit(x) for pair in LABEL_CLASSES.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), clean_label(label))
    return F.coalesce(found, F.lit("Normal"))
