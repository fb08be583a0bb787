"""Fixed values of binary forensics, in the order that results depend on."""

# Beginnings of symbols, the library they belong to, its licence.
SYMBOLS = [
    ("g_", "GLib", "LGPL-2.1-only"),
    ("gtk_", "GTK", "LGPL-2.1-only"),
    ("gst_", "GStreamer", "LGPL-2.1-only"),
    ("avcodec_", "FFmpeg/libavcodec", "LGPL-2.1-only"),
    ("avformat_", "FFmpeg/libavformat", "LGPL-2.1-only"),
    ("avutil_", "FFmpeg/libavutil", "LGPL-2.1-only"),
    ("swscale_", "FFmpeg/libswscale", "LGPL-2.1-only"),
    ("swresample_", "FFmpeg/libswresample", "LGPL-2.1-only"),
    ("av_", "FFmpeg", "LGPL-2.1-only"),
    ("x264_", "x264", "GPL-2.0-only"),
    ("x265_", "x265", "GPL-2.0-only"),
    ("lame_", "LAME", "LGPL-2.1-only"),
    ("mp3lame_", "LAME", "LGPL-2.1-only"),
    ("opus_", "Opus", "BSD-3-Clause"),
    ("vorbis_", "Vorbis", "BSD-3-Clause"),
    ("FLAC__", "FLAC", "BSD-3-Clause"),
    ("sqlite3_", "SQLite", "Public Domain"),
    ("curl_", "libcurl", "MIT"),
    ("SSL_", "OpenSSL", "Apache-2.0"),
    ("EVP_", "OpenSSL", "Apache-2.0"),
    ("OPENSSL_", "OpenSSL", "Apache-2.0"),
    ("gcry_", "Libgcrypt", "LGPL-2.1-only"),
    ("gpg_", "GnuPG", "GPL-3.0-only"),
    ("readline", "GNU Readline", "GPL-3.0-only"),
    ("rl_", "GNU Readline", "GPL-3.0-only"),
    ("ncurses", "ncurses", "MIT"),
    ("BZ2_", "bzip2", "BSD-3-Clause"),
    ("ZSTD_", "Zstandard", "BSD-3-Clause"),
    ("LZ4_", "LZ4", "BSD-2-Clause"),
    ("png_", "libpng", "Libpng"),
    ("jpeg_", "libjpeg", "IJG"),
    ("tiff_", "libtiff", "MIT"),
    ("FT_", "FreeType", "FTL"),
    ("hb_", "HarfBuzz", "MIT"),
    ("cairo_", "Cairo", "LGPL-2.1-only"),
    ("pango_", "Pango", "LGPL-2.1-only"),
    ("xml", "libxml2", "MIT"),
    ("pcre", "PCRE", "BSD-3-Clause"),
    ("lua_", "Lua", "MIT"),
    ("Py", "CPython", "PSF-2.0"),
    ("rb_", "Ruby", "BSD-2-Clause"),
]

# Texts of licences in binaries; bytes of context before and after one.
LICENCE_TEXTS = [
    "GNU General Public License",
    "Free Software Foundation",
    "LGPL",
    "GPL",
    "MIT License",
    "Permission is hereby granted",
    "Apache License",
    "BSD License",
    "Redistribution and use",
    "Mozilla Public License",
    "Creative Commons",
    "SPDX-License-Identifier",
    "Copyright (C)",
    "All rights reserved",
    "This program is free software",
    "under the terms of",
]
BEFORE, AFTER = 20, 80

# Go packages and their licences.
GO_LICENCES = [
    ("github.com/google/uuid", "BSD-3-Clause"),
    ("github.com/quic-go/quic-go", "MIT"),
    ("github.com/rs/zerolog", "MIT"),
    ("github.com/mattn/go-isatty", "MIT"),
    ("github.com/gorilla/websocket", "BSD-3-Clause"),
    ("github.com/gorilla/mux", "BSD-3-Clause"),
    ("github.com/sirupsen/logrus", "MIT"),
    ("github.com/stretchr/testify", "MIT"),
    ("github.com/spf13/cobra", "Apache-2.0"),
    ("github.com/spf13/viper", "MIT"),
    ("github.com/gin-gonic/gin", "MIT"),
    ("github.com/go-chi/chi", "MIT"),
    ("github.com/prometheus/client_golang", "Apache-2.0"),
    ("github.com/hashicorp/consul", "MPL-2.0"),
    ("github.com/hashicorp/vault", "MPL-2.0"),
    ("github.com/lib/pq", "MIT"),
    ("github.com/go-sql-driver/mysql", "MPL-2.0"),
    ("github.com/dgrijalva/jwt-go", "MIT"),
    ("github.com/golang-jwt/jwt", "MIT"),
]

# Forms of packages, addresses and functions in strings; least length of a string.
PACKAGE = r"github\.com/[a-zA-Z0-9_\-]+/[a-zA-Z0-9_\-]+"
ADDRESS = r"https?://[a-zA-Z0-9\.\-]+(?:/[a-zA-Z0-9\.\-/]*)?"
FUNCTION = r"main\.[a-zA-Z][a-zA-Z0-9_\.]*"
LEAST_STRING = 8

# Compilers by texts in their modules; the first that fits.
COMPILERS = [
    ("Go", ["Go build", "runtime.wasmExit", "syscall/js", "github.com/"]),
    ("Rust", ["__wbindgen", "wasm-bindgen"]),
    ("Emscripten", ["emscripten", "_emscripten_"]),
    ("AssemblyScript", ["~lib/rt", "assemblyscript"]),
]

# Kinds of addresses by words; the first that fits.
ADDRESS_KINDS = [
    ("SpeedTest", ["speedtest", "speed-test"]),
    ("Config", ["config", "settings"]),
    ("Telemetry", ["telemetry", "analytics"]),
    ("DataCollection", ["receive", "collect", "catcher"]),
    ("Api", ["api"]),
]

# Files beside a module that hold licences, notices, and others' notices.
LICENCE_BESIDE = ["LICENSE", "LICENSE.md", "LICENSE.txt"]
NOTICE_BESIDE = ["NOTICE", "NOTICE.md", "NOTICE.txt"]
THIRD_PARTY_BESIDE = ["THIRD_PARTY_NOTICES", "THIRD_PARTY_NOTICES.md", "THIRD_PARTY_NOTICES.txt", "THIRD-PARTY-NOTICES"]
