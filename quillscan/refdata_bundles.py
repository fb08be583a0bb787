"""Fixed values of bundle forensics, in the order that results depend on."""

# Libraries that bundles are searched for. Name, author, licence, family, least number of known texts,
# notice, known texts with confidence, known numbers with confidence, patterns of the version, restriction.
# Larger tables are read from TOML (operators.bundles.load_signatures).
LIBRARIES = [
    (
        "jQuery", "OpenJS Foundation and other contributors", "MIT", "permissive", 2, "(c) OpenJS Foundation",
        [("jQuery requires a window with a document", 0.99), ("jQuery.noConflict", 0.95), ("jQuery.fn.init", 0.95), ("jQuery.event.dispatch", 0.9), ("ajaxTransport", 0.85), ("isPlainObject", 0.6), ("jQuery.Deferred", 0.9), ("jQuery.parseHTML", 0.85), ("jQuery.ajaxSetup", 0.85), ("jQuery.holdReady", 0.9)],
        [],
        [r"jQuery\s*(?:JavaScript\s*Library\s*)?v?(\d+\.\d+\.\d+)"],
        None,
    ),
    (
        "React", "Meta Platforms, Inc.", "MIT", "permissive", 2, "Meta Platforms, Inc.",
        [("__SECRET_INTERNALS_DO_NOT_USE_OR_YOU_WILL_BE_FIRED", 0.99), ("react.element", 0.9), ("react.fragment", 0.85), ("react.portal", 0.85), ("react.strict_mode", 0.9), ("Invalid hook call", 0.95), ("react.suspense", 0.85), ("react.memo", 0.8)],
        [],
        [r"react[./]v?(\d+\.\d+\.\d+)"],
        None,
    ),
    (
        "Vue.js", "Evan You", "MIT", "permissive", 2, "Evan You",
        [("__vue__", 0.95), ("Vue.use", 0.8), ("Vue.component", 0.8), ("Vue.directive", 0.8), ("createApp", 0.55), ("Vue.nextTick", 0.85), ("v-model", 0.5), ("$emit", 0.4), ("vue-router", 0.8)],
        [],
        [r"Vue\.js\s*v?(\d+\.\d+\.\d+)", r"vue@(\d+\.\d+\.\d+)"],
        None,
    ),
    (
        "Lodash", "John-David Dalton", "MIT", "permissive", 3, "John-David Dalton",
        [("Expected a function", 0.7), ("__wrapped__", 0.95), ("lodash", 0.7), ("_.debounce", 0.75), ("_.throttle", 0.75), ("_.cloneDeep", 0.8), ("_.isPlainObject", 0.6), ("_.merge", 0.5), ("LARGE_ARRAY_SIZE", 0.9)],
        [],
        [r"lodash\s*v?(\d+\.\d+\.\d+)"],
        None,
    ),
    (
        "RxJS", "Google LLC and RxJS contributors", "Apache-2.0", "permissive_notice", 2, "Google LLC",
        [("Observable", 0.45), ("BehaviorSubject", 0.8), ("ReplaySubject", 0.8), ("switchMap", 0.6), ("mergeMap", 0.6), ("combineLatest", 0.65), ("ObjectUnsubscribedError", 0.95)],
        [],
        [],
        None,
    ),
    (
        "CryptoJS", "Jeff Mott, Evan Vosberg", "MIT", "permissive", 3, "Jeff Mott",
        [("CryptoJS", 0.95), ("WordArray", 0.6), ("BufferedBlockAlgorithm", 0.95), ("StreamCipher", 0.7), ("EvpKDF", 0.9), ("SerializableCipher", 0.9), ("PasswordBasedCipher", 0.9), ("OpenSSLFormatter", 0.9), ("CipherParams", 0.85)],
        [("1732584193", 0.85), ("4023233417", 0.85), ("2562383102", 0.85), ("271733878", 0.85), ("3285377520", 0.9), ("1518500249", 0.9), ("1859775393", 0.9), ("2400959708", 0.9), ("3395469782", 0.9)],
        [],
        None,
    ),
    (
        "D3.js", "Mike Bostock", "ISC", "permissive", 2, "Mike Bostock",
        [("d3.select", 0.85), ("d3.scaleLinear", 0.9), ("d3.axisBottom", 0.9), ("d3.transition", 0.8), ("d3.geoPath", 0.9), ("d3.hierarchy", 0.85)],
        [],
        [r"d3\.?js\s*v?(\d+\.\d+\.\d+)"],
        None,
    ),
    ("Webpack Runtime", "Tobias Koppers", "MIT", "permissive", 1, "Tobias Koppers", [("__webpack_require__", 0.99), ("__webpack_modules__", 0.95), ("webpackChunk", 0.9), ("__webpack_exports__", 0.9)], [], [], None),
    ("webextension-polyfill", "Mozilla", "MPL-2.0", "weak_copyleft", 2, "Mozilla", [("browser-polyfill", 0.85), ("wrapAPIs", 0.8), ("settingMetadata", 0.8), ("onRequestFinished", 0.8)], [], [], None),
    ("GPL-licensed code marker", "Various", "GPL-2.0-or-later", "strong_copyleft", 1, "Free Software Foundation", [("GNU General Public License", 0.95), ("WITHOUT ANY WARRANTY; without even the implied warranty", 0.99), ("General Public License as published by the Free Software Foundation", 0.99)], [], [], None),
    ("AGPL-licensed code marker", "Various", "AGPL-3.0", "strong_copyleft", 1, "Free Software Foundation", [("GNU Affero General Public License", 0.99), ("Affero General Public License as published by", 0.99)], [], [], None),
    (
        "FuzzySet.js", "Glen Chiacchieri", "Prosperity-3.0.0", "commercial_restricted", 2, "Glen Chiacchieri",
        [("FuzzySet", 0.85), ("gramSizeLower", 0.95), ("gramSizeUpper", 0.9), ("useLevenshtein", 0.8)],
        [('"use strict";return function(', 0.95)],
        [],
        "Prosperity Public License 3.0.0: commercial use is limited to a trial of 32 days",
    ),
    (
        "Joseph Myers MD5", "Joseph Myers", "UNLICENSED", "proprietary", 2, "Joseph Myers",
        [("Andy King", 0.99), ("hex_chr", 0.85), ("md5cycle", 0.95), ("md5blk", 0.95), ("md51", 0.9)],
        [("1732584193", 0.7), ("-271733879", 0.9), ("-1732584194", 0.9), ("271733878", 0.7)],
        [],
        "no licence was ever published",
    ),
]

# What a claim looks like; year and holder are its groups.
CLAIM = r"(?i)(?:copyright|©|\(c\))\s*(?:(\d{4}(?:\s*[-–,]\s*\d{4})?)?\s*,?\s*)([^*/\n\r]{3,80})"
ALL_RIGHTS = r"(?i)all\s+rights\s+reserved"

# Files that name authors, and files that hold a licence or a notice, in the order they are looked for.
ATTRIBUTION_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "NOTICE", "NOTICE.md", "NOTICE.txt", "ATTRIBUTION", "ATTRIBUTION.md", "THIRD_PARTY", "THIRD_PARTY.md", "THIRD_PARTY_NOTICES", "THIRD_PARTY_NOTICES.md", "CREDITS", "CREDITS.md", "COPYING"]
BUNDLE_EXTENSIONS = ["js", "mjs", "cjs", "css", "htm", "html"]
