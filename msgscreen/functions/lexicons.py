"""Word lists, top-level domains and wording that results depend on.

The lists keep their order and their two repeated entries, because hits are
reported in list order and once per entry.
"""

from __future__ import annotations

# Words looked for inside a lower-cased URL.
ENGLISH = [
    "verify", "verification", "secure", "security", "login", "signin", "account", "update", "click",
    "confirm", "banking", "payment", "paypal", "amazon", "apple", "microsoft", "support", "service",
    "suspend", "suspended", "urgent", "immediate", "action-required", "free", "winner", "won",
    "prize", "reward", "bonus", "password", "credential", "credentials", "reset", "recovery",
    "unlock", "locked", "access", "limited", "restricted", "alert", "warning", "notice", "billing",
    "invoice",
]
FRENCH = [
    "vérifier", "verification", "sécurisé", "sécurité", "connexion", "compte", "mise-a-jour",
    "miseajour", "cliquez", "cliquer", "confirmer", "confirmation", "bancaire", "paiement",
    "suspension", "suspendu", "urgent", "immédiat", "gratuit", "gagnant", "gain", "prix",
    "récompense", "mot-de-passe", "identifiant", "réinitialiser", "réactivation", "débloquer",
    "bloqué", "accès", "limité", "restreint", "alerte", "avertissement", "facture",
]
ARABIC = [
    "توثيق", "تحقق", "تأكيد", "تفعيل", "حساب", "حسابك", "تسجيل", "دخول", "بنك", "بنكي", "دفع",
    "فاتورة", "تحديث", "تجديد", "إعادة", "إعادة-تعيين", "كلمة-السر", "كلمة-مرور", "رمز",
    "رمز-التحقق", "معلق", "موقوف", "إيقاف", "تعليق", "عاجل", "فوري", "تحذير", "تنبيه", "جائزة",
    "ربح", "هدية", "مجاني", "استرجاع", "استعادة", "تأكيد-الهوية",
]
WORDS = ENGLISH + FRENCH + ARABIC

# Top-level domains, compared with their case.
TLDS = [
    ".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".club", ".online", ".site", ".store",
    ".website", ".space", ".fun", ".click", ".live", ".work", ".support", ".review", ".party",
    ".trade", ".account", ".download", ".stream", ".loan", ".win",
]

# The smaller lists.
SMALL_WORDS = [
    "verify", "secure", "login", "account", "update", "click", "confirm", "banking", "paypal",
    "amazon", "apple", "microsoft", "support", "suspend", "urgent", "free", "winner", "prize",
    "password", "credential",
]
SMALL_TLDS = [".xyz", ".ru", ".tk", ".ml", ".ga", ".cf", ".gq", ".top"]

# Schemes whose last path segment may carry ';params' (the empty one included).
PARAM_SCHEMES = [
    "", "ftp", "hdl", "prospero", "http", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip", "sips",
    "mms", "sftp", "tel",
]

# Wording of the feature text, one entry per line of output.
FEATURE_TEXT = {
    "en": {
        "url": "URL analyzed: ", "domain": "Domain: ", "subdomain": "Subdomain: ", "path": "Path: ",
        "scheme": "Protocol: ", "url_length": "Total length: ", "url_length_unit": " characters",
        "has_ip": "Contains IP address: ", "has_at": "Contains @: ",
        "dash_count": "Dashes in domain: ", "subdomain_count": "Number of subdomains: ",
        "is_https": "HTTPS: ", "suspicious_tld": "Suspicious TLD: ",
        "suspicious_words": "Suspicious words detected: ",
        "yes": "yes", "no": "no", "none": "none",
    },
    "fr": {
        "url": "URL analysée : ", "domain": "Domaine : ", "subdomain": "Sous-domaine : ",
        "path": "Chemin : ", "scheme": "Protocole : ", "url_length": "Longueur totale : ",
        "url_length_unit": " caractères", "has_ip": "Contient une IP : ",
        "has_at": "Contient @ : ", "dash_count": "Nombre de tirets dans le domaine : ",
        "subdomain_count": "Nombre de sous-domaines : ", "is_https": "HTTPS : ",
        "suspicious_tld": "Extension suspecte : ", "suspicious_words": "Mots suspects détectés : ",
        "yes": "oui", "no": "non", "none": "aucun",
    },
}
