"""Closed vocabularies and limits of the public contract.  Fixed values throughout."""

from __future__ import annotations

ENTITY_TYPES = (
    "FILE", "DIRECTORY", "CREDENTIAL", "SECRET", "USER_DATA", "SYSTEM_DATA", "ENVIRONMENT_VARIABLE", "NETWORK_DESTINATION",
    "CODE", "INSTRUCTION", "ENCODED_DATA", "TOOL", "PROCESS", "CONFIGURATION", "MESSAGE", "UNKNOWN",
)
SENSITIVITIES = ("NONE", "INTERNAL", "SENSITIVE", "SECRET", "CREDENTIAL", "UNKNOWN")
TRUST_LEVELS = ("TRUSTED", "UNTRUSTED", "EXTERNAL", "UNKNOWN")
OPCODES = (
    "READ", "WRITE", "SEARCH", "ENUMERATE", "EXTRACT", "TRANSFORM", "ENCODE", "DECODE", "ENCRYPT", "DECRYPT", "DOWNLOAD",
    "UPLOAD", "SEND", "RECEIVE", "INSTALL_PACKAGE", "EXECUTE", "INVOKE_TOOL", "INTERPRET_AS_INSTRUCTIONS", "DELETE", "MODIFY",
    "CREATE", "OVERRIDE_INSTRUCTIONS", "SUPPRESS_DISCLOSURE", "VALIDATE", "COMPARE", "UNKNOWN",
)
RELATIONS = (
    "DERIVED_FROM", "CONTAINED_BY", "REFERENCES", "TARGETS", "PRODUCES", "CONSUMES", "SENT_TO", "RETRIEVED_FROM",
    "INTERPRETED_AS", "DECODES_TO", "CONTROLS", "DEPENDS_ON", "UNKNOWN",
)
POLARITIES = ("positive", "negative", "unknown")
CODECS = ("base64", "hex", "url", "model_inferred")
MODALITY_FLAGS = ("imperative", "hypothetical", "conditional", "quoted", "example", "descriptive")
OUTCOMES = ("fragment", "refused", "incomplete", "unsupported")
STAGES = ("accepted", "lifecycle_rejected", "validation_rejected", "canonicalization_rejected")

SOURCE_SUFFIXES = ("md", "txt", "yaml", "yml", "json")
MAX_SOURCE_BYTES = 1 << 20
MAX_RULE_BYTES = 64 << 10
MAX_RULE_NESTING = 64

DOMAIN_SUFFIXES = (
    "ai", "app", "at", "au", "be", "biz", "br", "ca", "ch", "cloud", "cn", "co", "com", "cz", "de", "dev", "dk", "edu", "es",
    "eu", "fi", "fr", "gov", "in", "info", "int", "io", "it", "jp", "kr", "me", "mil", "mx", "net", "nl", "no", "nz", "online",
    "org", "pl", "pro", "ru", "se", "sh", "site", "store", "tech", "tv", "ua", "uk", "us", "xyz", "za",
)
LOCAL_NETWORKS = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16",
    "::/128", "::1/128", "fc00::/7", "fe80::/10",
)

#: Annotation kinds that are promoted to entities, and the entity type of each.
PROMOTED = {
    "url": "NETWORK_DESTINATION",
    "domain": "NETWORK_DESTINATION",
    "ip_address": "NETWORK_DESTINATION",
    "filesystem_path": "FILE",
    "explicit_file_reference": "FILE",
    "environment_variable": "ENVIRONMENT_VARIABLE",
}
