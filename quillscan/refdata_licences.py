"""Fixed values of licence-text forensics and licence tables."""

from __future__ import annotations

# Phrases of restrictions that standard licences do not have, and their kinds.
RESTRICTIONS = [
    ("commercial use is not permitted", "CommercialRestriction"),
    ("commercial purposes", "CommercialRestriction"),
    ("non-commercial use only", "CommercialRestriction"),
    ("for internal use only", "CommercialRestriction"),
    ("not for resale", "CommercialRestriction"),
    ("may not be used for commercial", "CommercialRestriction"),
    ("evaluation purposes only", "CommercialRestriction"),
    ("academic use only", "CommercialRestriction"),
    ("educational purposes only", "CommercialRestriction"),
    ("personal use only", "CommercialRestriction"),
    ("export restrictions", "GeographicRestriction"),
    ("not available in", "GeographicRestriction"),
    ("jurisdictions where", "GeographicRestriction"),
    ("embargo", "GeographicRestriction"),
    ("may not be used in the field of", "FieldOfUseRestriction"),
    ("not to be used for", "FieldOfUseRestriction"),
    ("restricted to", "FieldOfUseRestriction"),
    ("military", "FieldOfUseRestriction"),
    ("weapons", "FieldOfUseRestriction"),
    ("surveillance", "FieldOfUseRestriction"),
    ("law enforcement", "FieldOfUseRestriction"),
    ("must display", "EnhancedAttribution"),
    ("prominently display", "EnhancedAttribution"),
    ("powered by", "EnhancedAttribution"),
    ("badge requirement", "EnhancedAttribution"),
    ("logo must appear", "EnhancedAttribution"),
    ("shall indemnify", "Indemnification"),
    ("shall hold harmless", "Indemnification"),
    ("indemnification", "Indemnification"),
    ("non-compete", "NonCompete"),
    ("shall not compete", "NonCompete"),
    ("competing product", "NonCompete"),
    ("telemetry", "DataCollection"),
    ("usage data", "DataCollection"),
    ("analytics", "DataCollection"),
    ("phone home", "DataCollection"),
]
# Clauses that a declared licence's text must hold: licence, clause, obligation, snippet.
CLAUSES = [
    ("MIT", "Permission Grant", "Attribution", "Permission is hereby granted, free of charge"),
    ("MIT", "Attribution Requirement", "Attribution", "The above copyright notice and this permission notice shall be included"),
    ("MIT", "No Warranty", "Warranty", 'THE SOFTWARE IS PROVIDED "AS IS"'),
    ("APACHE", "Copyright Grant", "Attribution", "perpetual, worldwide, non-exclusive, no-charge, royalty-free"),
    ("APACHE", "Patent Grant", "PatentGrant", "grant of patent license"),
    ("APACHE", "Patent Termination", "PatentGrant", "patent license"),
    ("APACHE", "NOTICE Preservation", "NoticeFile", "NOTICE"),
    ("APACHE", "Modification Notice", "ModificationNotice", "cause any modified files to carry prominent notices"),
    ("APACHE", "Trademark Restriction", "TrademarkRestriction", "trade names, trademarks, service marks"),
    ("GPL", "Freedom to Run", "Copyleft", "freedom to run the program"),
    ("GPL", "Source Disclosure", "SourceDisclosure", "Corresponding Source"),
    ("GPL", "Copyleft", "Copyleft", "convey a work based on the Program"),
    ("GPL", "Anti-Tivoization", "Copyleft", "Installation Information"),
    ("GPL", "Patent Non-Aggression", "PatentGrant", "patent license"),
    ("AGPL", "Network Use Provision", "NetworkUse", "interact with it remotely through a computer network"),
    ("BSD-3", "Source Attribution", "Attribution", "Redistributions of source code must retain"),
    ("BSD-3", "Binary Attribution", "Attribution", "Redistributions in binary form must reproduce"),
    ("BSD-3", "No Endorsement", "TrademarkRestriction", "endorse or promote products derived"),
    ("MPL", "File-Level Copyleft", "Copyleft", "Covered Software"),
    ("MPL", "Source Form Distribution", "SourceDisclosure", "Source Code Form"),
    ("MPL", "Patent Grant", "PatentGrant", "patent license"),
]
# What a missing clause of an obligation takes from the trust in a text; any other 0.05.
CLAUSE_PENALTIES = {"SourceDisclosure": 0.25, "Copyleft": 0.25, "NetworkUse": 0.25, "Attribution": 0.15, "PatentGrant": 0.15, "NoticeFile": 0.15}
# Names of sections that standard licences do not have.
EXTRA_SECTIONS = ["additional terms", "supplemental terms", "special conditions", "addendum", "amendment", "rider", "schedule a", "exhibit a"]
# What marks a licence version in a text.
VERSION_MARKERS = [
    ("GPL-2.0", ["version 2", "gpl-2.0", "gnu general public license\nversion 2"]),
    ("GPL-3.0", ["version 3", "gpl-3.0", "gnu general public license\nversion 3"]),
    ("LGPL-2.1", ["version 2.1", "lgpl-2.1"]),
    ("LGPL-3.0", ["version 3", "lgpl-3.0"]),
    ("AGPL-3.0", ["version 3", "agpl-3.0", "affero"]),
    ("MPL-2.0", ["version 2.0", "mpl-2.0", "mozilla public license version 2"]),
    ("Apache-2.0", ["version 2.0", "apache-2.0", "apache license, version 2"]),
]
VERSION_FAMILIES = ["GPL", "LGPL", "AGPL", "MPL", "APACHE"]
# Phrases that a machine translation leaves.
TRANSLATED = ["is provided as is", "without guaranty", "the program is free", "all rights are reserved", "the licence", "authorisation", "programme"]
# Code points of bidirectional overrides and of invisible formatting.
BIDI = [0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069]
INVISIBLE = [0x2028, 0x2029, 0x00AD, 0x034F, 0x17B4, 0x17B5]
# Known licences: id, name, family, obligations, OSI approved, FSF free, fit for proprietary use, spellings, file names, header phrases.
LICENCES = [
    ("GPL-2.0-only", "GNU General Public License v2.0", "StrongCopyleft", ["Attribution", "SourceDisclosure", "Copyleft", "ChangeDocumentation"], True, True, False, ["GPL-2.0-only", "GPL-2.0", "GPLv2"], ["COPYING", "LICENSE"], ["GNU General Public License", "version 2", "Free Software Foundation"]),
    ("GPL-3.0-only", "GNU General Public License v3.0", "StrongCopyleft", ["Attribution", "SourceDisclosure", "Copyleft", "ChangeDocumentation", "PatentGrant"], True, True, False, ["GPL-3.0-only", "GPL-3.0", "GPLv3"], ["COPYING", "LICENSE"], ["GNU General Public License", "version 3", "either version 3"]),
    ("AGPL-3.0-only", "GNU Affero General Public License v3.0", "NetworkCopyleft", ["Attribution", "SourceDisclosure", "Copyleft", "NetworkDisclosure", "ChangeDocumentation", "PatentGrant"], True, True, False, ["AGPL-3.0-only", "AGPL-3.0", "AGPLv3"], ["COPYING", "LICENSE"], ["GNU Affero General Public License", "Affero", "interact with it remotely"]),
    ("LGPL-2.1-only", "GNU Lesser General Public License v2.1", "WeakCopyleft", ["Attribution", "ModifiedFileDisclosure", "DynamicLinkingRequired", "ChangeDocumentation"], True, True, True, ["LGPL-2.1-only", "LGPL-2.1", "LGPLv2.1"], ["COPYING.LESSER", "LICENSE"], ["GNU Lesser General Public License", "Lesser General Public"]),
    ("MPL-2.0", "Mozilla Public License 2.0", "WeakCopyleft", ["Attribution", "ModifiedFileDisclosure", "PatentGrant"], True, True, True, ["MPL-2.0"], ["LICENSE"], ["Mozilla Public License", "MPL"]),
    ("EPL-2.0", "Eclipse Public License 2.0", "WeakCopyleft", ["Attribution", "ModifiedFileDisclosure", "PatentGrant"], True, True, True, ["EPL-2.0"], ["LICENSE"], ["Eclipse Public License"]),
    ("SSPL-1.0", "Server Side Public License v1", "NetworkCopyleft", ["Attribution", "SourceDisclosure", "Copyleft", "NetworkDisclosure"], False, False, False, ["SSPL-1.0", "SSPL"], ["LICENSE"], ["Server Side Public License", "SSPL"]),
    ("Apache-2.0", "Apache License 2.0", "PermissivePatent", ["Attribution", "NoticeFile", "PatentGrant", "ChangeDocumentation", "TrademarkRestriction"], True, True, True, ["Apache-2.0"], ["LICENSE", "NOTICE"], ["Apache License", "Version 2.0", "Licensed under the Apache License"]),
    ("MIT", "MIT License", "Permissive", ["Attribution", "HeaderPreservation"], True, True, True, ["MIT"], ["LICENSE", "LICENSE.md"], ["Permission is hereby granted", "MIT License", "The MIT License"]),
    ("BSD-2-Clause", "BSD 2-Clause \"Simplified\" License", "Permissive", ["Attribution"], True, True, True, ["BSD-2-Clause"], ["LICENSE"], ["Redistribution and use in source and binary", "2-Clause"]),
    ("BSD-3-Clause", "BSD 3-Clause \"New\" License", "Permissive", ["Attribution", "TrademarkRestriction"], True, True, True, ["BSD-3-Clause"], ["LICENSE"], ["Redistribution and use in source and binary", "Neither the name", "3-Clause"]),
    ("ISC", "ISC License", "Permissive", ["Attribution"], True, True, True, ["ISC"], ["LICENSE"], ["ISC License", "Permission to use, copy, modify"]),
    ("Unlicense", "The Unlicense", "PublicDomain", [], True, True, True, ["Unlicense"], ["UNLICENSE", "LICENSE"], ["This is free and unencumbered software", "released into the public domain"]),
    ("CC0-1.0", "Creative Commons Zero v1.0 Universal", "PublicDomain", [], False, True, True, ["CC0-1.0", "CC0"], ["LICENSE"], ["CC0", "Creative Commons Zero", "No Copyright"]),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0", "CreativeCommons", ["Attribution"], False, True, True, ["CC-BY-4.0"], ["LICENSE"], ["Creative Commons Attribution"]),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0", "CreativeCommons", ["Attribution", "ShareAlike"], False, True, False, ["CC-BY-SA-4.0"], ["LICENSE"], ["Attribution-ShareAlike"]),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0", "CreativeCommonsRestricted", ["Attribution", "NonCommercial"], False, False, False, ["CC-BY-NC-4.0"], ["LICENSE"], ["NonCommercial"]),
]

# Names of Creative Commons licences in texts and URLs, and their ids.
CC_TEXTS = [
    ("creative commons attribution 4.0", "CC-BY-4.0"),
    ("creative commons attribution-sharealike 4.0", "CC-BY-SA-4.0"),
    ("creative commons attribution-noncommercial 4.0", "CC-BY-NC-4.0"),
    ("creative commons attribution-noderivatives 4.0", "CC-BY-ND-4.0"),
    ("creative commons attribution-noncommercial-sharealike 4.0", "CC-BY-NC-SA-4.0"),
    ("creative commons attribution-noncommercial-noderivatives 4.0", "CC-BY-NC-ND-4.0"),
    ("creative commons attribution 3.0", "CC-BY-3.0"),
    ("creative commons attribution-sharealike 3.0", "CC-BY-SA-3.0"),
    ("creative commons attribution-noncommercial 3.0", "CC-BY-NC-3.0"),
    ("creative commons attribution-noderivatives 3.0", "CC-BY-ND-3.0"),
    ("creative commons attribution-noncommercial-sharealike 3.0", "CC-BY-NC-SA-3.0"),
    ("creative commons attribution-noncommercial-noderivatives 3.0", "CC-BY-NC-ND-3.0"),
    ("creative commons zero", "CC0-1.0"),
    ("cc0 1.0 universal", "CC0-1.0"),
    ("public domain dedication", "CC0-1.0"),
    ("cc-by-4.0", "CC-BY-4.0"),
    ("cc-by-sa-4.0", "CC-BY-SA-4.0"),
    ("cc-by-nc-4.0", "CC-BY-NC-4.0"),
    ("cc-by-nd-4.0", "CC-BY-ND-4.0"),
    ("cc-by-nc-sa-4.0", "CC-BY-NC-SA-4.0"),
    ("cc-by-nc-nd-4.0", "CC-BY-NC-ND-4.0"),
    ("cc-by-3.0", "CC-BY-3.0"),
    ("cc-by-sa-3.0", "CC-BY-SA-3.0"),
    ("cc-by-nc-3.0", "CC-BY-NC-3.0"),
    ("cc-by-nd-3.0", "CC-BY-ND-3.0"),
    ("cc-by-nc-sa-3.0", "CC-BY-NC-SA-3.0"),
    ("cc-by-nc-nd-3.0", "CC-BY-NC-ND-3.0"),
]
CC_URLS = [
    ("creativecommons.org/licenses/by/4.0", "CC-BY-4.0"),
    ("creativecommons.org/licenses/by-sa/4.0", "CC-BY-SA-4.0"),
    ("creativecommons.org/licenses/by-nc/4.0", "CC-BY-NC-4.0"),
    ("creativecommons.org/licenses/by-nd/4.0", "CC-BY-ND-4.0"),
    ("creativecommons.org/licenses/by-nc-sa/4.0", "CC-BY-NC-SA-4.0"),
    ("creativecommons.org/licenses/by-nc-nd/4.0", "CC-BY-NC-ND-4.0"),
    ("creativecommons.org/licenses/by/3.0", "CC-BY-3.0"),
    ("creativecommons.org/licenses/by-sa/3.0", "CC-BY-SA-3.0"),
    ("creativecommons.org/licenses/by-nc/3.0", "CC-BY-NC-3.0"),
    ("creativecommons.org/licenses/by-nd/3.0", "CC-BY-ND-3.0"),
    ("creativecommons.org/licenses/by-nc-sa/3.0", "CC-BY-NC-SA-3.0"),
    ("creativecommons.org/licenses/by-nc-nd/3.0", "CC-BY-NC-ND-3.0"),
    ("creativecommons.org/publicdomain/zero/1.0", "CC0-1.0"),
    ("creativecommons.org/licenses/by/2.0", "CC-BY-2.0"),
    ("creativecommons.org/licenses/by-sa/2.0", "CC-BY-SA-2.0"),
    ("creativecommons.org/licenses/by-nc/2.0", "CC-BY-NC-2.0"),
    ("creativecommons.org/licenses/by/2.5", "CC-BY-2.5"),
    ("creativecommons.org/licenses/by-sa/2.5", "CC-BY-SA-2.5"),
]
# Files that give credit, and words of commercial use with their kinds.
CREDIT_FILES = [
    "CREDITS",
    "CREDITS.md",
    "CREDITS.txt",
    "ATTRIBUTION",
    "ATTRIBUTION.md",
    "ATTRIBUTION.txt",
    "THIRD-PARTY-NOTICES",
    "THIRD-PARTY-NOTICES.md",
    "THIRD_PARTY_NOTICES",
    "THIRD_PARTY_NOTICES.md",
    "ACKNOWLEDGMENTS",
    "ACKNOWLEDGMENTS.md",
    "ACKNOWLEDGEMENTS",
    "ACKNOWLEDGEMENTS.md",
    "NOTICE",
    "NOTICE.md",
    "NOTICE.txt",
    "AUTHORS",
    "AUTHORS.md",
    "AUTHORS.txt",
    "CONTRIBUTORS",
    "CONTRIBUTORS.md",
]
COMMERCIAL = [
    ("stripe", "PaymentProcessing"),
    ("paypal", "PaymentProcessing"),
    ("braintree", "PaymentProcessing"),
    ("square", "PaymentProcessing"),
    ("payment_intent", "PaymentProcessing"),
    ("checkout.session", "PaymentProcessing"),
    ("gumroad", "PaymentProcessing"),
    ("lemonsqueezy", "PaymentProcessing"),
    ("paddle", "PaymentProcessing"),
    ("google_ad", "Advertising"),
    ("adsense", "Advertising"),
    ("adwords", "Advertising"),
    ("doubleclick", "Advertising"),
    ("facebook pixel", "Advertising"),
    ("fbevents", "Advertising"),
    ("analytics.js", "Advertising"),
    ("gtag", "Advertising"),
    ("google tag manager", "Advertising"),
    ("shopping cart", "Ecommerce"),
    ("add to cart", "Ecommerce"),
    ("checkout", "Ecommerce"),
    ("shopify", "Ecommerce"),
    ("woocommerce", "Ecommerce"),
    ("magento", "Ecommerce"),
    ("product_price", "Ecommerce"),
    ("buy now", "Ecommerce"),
    ("purchase", "Ecommerce"),
    ("subscription", "SaasIndicators"),
    ("premium plan", "SaasIndicators"),
    ("free tier", "SaasIndicators"),
    ("api_key", "SaasIndicators"),
    ("rate_limit", "SaasIndicators"),
    ("billing", "SaasIndicators"),
    ("pro plan", "SaasIndicators"),
    ("enterprise", "SaasIndicators"),
    ("pricing", "SaasIndicators"),
]
# Exceptions that keep a copyleft licence from passing on.
NEUTRALISING = [
    "Classpath-exception-2.0",
    "GCC-exception-3.1",
    "Autoconf-exception-3.0",
    "Autoconf-exception-generic",
    "Autoconf-exception-macro",
    "Bison-exception-2.2",
    "FLTK-exception",
    "Font-exception-2.0",
    "LZMA-exception",
    "Libtool-exception",
    "Linux-syscall-note",
    "Nokia-Qt-exception-1.1",
    "OpenVPN-openssl-exception",
    "PS-or-PDF-font-exception-20170817",
    "Qt-LGPL-exception-1.1",
    "Qt-no-exception",
    "Swift-exception",
    "Universal-FOSS-exception-1.0",
    "WxWindows-exception-3.1",
    "eCos-exception-2.0",
    "gnu-compiler-exception",
    "i2p-gpl-java-exception",
    "mif-exception",
    "u-boot-exception-2.0",
]
# How surely contamination crosses a kind of linking; any other 0.5.
LINK_FACTORS = {"Source": 1.0, "Static": 1.0, "Dynamic": 0.85, "HeaderOnly": 0.7, "Unknown": 0.6}
