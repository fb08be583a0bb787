"""Fixed values of web asset checks."""

from __future__ import annotations

# Hosts of content delivery networks and their names.
CDN_HOSTS = [
    ("cdnjs.cloudflare.com", "Cdnjs"),
    ("cdn.jsdelivr.net", "JsDelivr"),
    ("unpkg.com", "Unpkg"),
    ("ajax.googleapis.com", "GoogleCdn"),
    ("cdnjs.com", "CloudflareCdn"),
    ("maxcdn.bootstrapcdn.com", "BootstrapCdn"),
    ("stackpath.bootstrapcdn.com", "StackPathCdn"),
    ("code.jquery.com", "JqueryCdn"),
    ("ajax.aspnetcdn.com", "MicrosoftCdn"),
    ("use.fontawesome.com", "FontAwesomeCdn"),
    ("kit.fontawesome.com", "FontAwesomeCdn"),
    ("ka-f.fontawesome.com", "FontAwesomeCdn"),
]
# Libraries and their licences; the first whose name is in a library counts.
CDN_LICENCES = [
    ("jquery", "MIT"),
    ("react", "MIT"),
    ("react-dom", "MIT"),
    ("vue", "MIT"),
    ("angular", "MIT"),
    ("d3", "ISC"),
    ("lodash", "MIT"),
    ("moment", "MIT"),
    ("axios", "MIT"),
    ("bootstrap", "MIT"),
    ("tailwindcss", "MIT"),
    ("foundation", "MIT"),
    ("bulma", "MIT"),
    ("popper.js", "MIT"),
    ("chart.js", "MIT"),
    ("three.js", "MIT"),
    ("socket.io", "MIT"),
    ("leaflet", "BSD-2-Clause"),
    ("underscore", "MIT"),
    ("backbone", "MIT"),
    ("ember", "MIT"),
    ("handlebars", "MIT"),
    ("mustache", "MIT"),
    ("knockout", "MIT"),
    ("mithril", "MIT"),
    ("preact", "MIT"),
    ("svelte", "MIT"),
    ("alpine", "MIT"),
    ("htmx", "BSD-2-Clause"),
    ("highlight.js", "BSD-3-Clause"),
    ("prism", "MIT"),
    ("animate.css", "MIT"),
    ("normalize.css", "MIT"),
    ("font-awesome", "Font: SIL OFL 1.1, CSS: MIT, Pro: Commercial"),
    ("material-icons", "Apache-2.0"),
    ("ionicons", "MIT"),
    ("feather-icons", "MIT"),
    ("heroicons", "MIT"),
    ("swiper", "MIT"),
    ("gsap", "Standard: Free, Business: Commercial GSAP License"),
    ("lottie", "MIT"),
    ("howler", "MIT"),
    ("tone.js", "MIT"),
    ("wavesurfer.js", "BSD-3-Clause"),
    ("plyr", "MIT"),
]
# Hosted fonts and their licences; any other OFL.
GOOGLE_FONTS = [
    ("Roboto", "Apache2"),
    ("Open Sans", "Apache2"),
    ("Lato", "OFL"),
    ("Montserrat", "OFL"),
    ("Poppins", "OFL"),
    ("Inter", "OFL"),
    ("Raleway", "OFL"),
    ("Nunito", "OFL"),
    ("Ubuntu", "UFL"),
    ("Playfair Display", "OFL"),
    ("Source Sans Pro", "OFL"),
    ("Source Code Pro", "OFL"),
    ("Fira Code", "OFL"),
    ("JetBrains Mono", "OFL"),
    ("DM Sans", "OFL"),
    ("Space Grotesk", "OFL"),
    ("Space Mono", "OFL"),
    ("IBM Plex Sans", "OFL"),
    ("IBM Plex Mono", "OFL"),
    ("Inconsolata", "OFL"),
    ("Outfit", "OFL"),
    ("Work Sans", "OFL"),
    ("Manrope", "OFL"),
    ("Merriweather", "OFL"),
    ("PT Sans", "OFL"),
    ("Noto Sans", "OFL"),
    ("Noto Serif", "OFL"),
    ("Material Symbols", "Apache2"),
]
# Names of commercial fonts.
COMMERCIAL_FONTS = [
    "Helvetica",
    "Arial",
    "Times New Roman",
    "Garamond",
    "Futura",
    "Avenir",
    "Proxima Nova",
    "Gotham",
    "Freight",
    "Neue Haas Grotesk",
    "Akzidenz Grotesk",
    "Univers",
    "Frutiger",
    "Gill Sans",
    "Optima",
    "Palatino",
    "Baskerville",
    "Caslon",
    "Clarendon",
    "Didot",
    "SF Pro",
    "SF Mono",
    "San Francisco",
    "Segoe UI",
    "Apercu",
    "Circular",
    "Graphik",
    "Suisse",
    "Neue Montreal",
    "GT Walsheim",
    "GT America",
    "Founders Grotesk",
    "Calibre",
    "Brandon Grotesque",
    "TT Norms",
    "Monument Extended",
    "Canela",
    "Reckless",
    "Editorial New",
    "PP Neue Montreal",
]
# Marks of images in page heads.
META_IMAGES = [
    ("og:image", "Open Graph Image"),
    ("twitter:image", "Twitter Card Image"),
    ("apple-touch-icon", "Apple Touch Icon"),
    ("msapplication-tileimage", "MS Tile Image"),
]
# Class names of icon libraries with library and tier.
ICONS = [
    ("fa-solid", "FontAwesome", "Free"),
    ("fa-regular", "FontAwesome", "Free"),
    ("fa-brands", "FontAwesome", "Free"),
    ("fa-light", "FontAwesome", "Pro"),
    ("fa-thin", "FontAwesome", "Pro"),
    ("fa-duotone", "FontAwesome", "Pro"),
    ("fa-sharp", "FontAwesome", "Pro"),
    ("fas fa-", "FontAwesome", "Free"),
    ("far fa-", "FontAwesome", "Free"),
    ("fab fa-", "FontAwesome", "Free"),
    ("fal fa-", "FontAwesome", "Pro"),
    ("fad fa-", "FontAwesome", "Pro"),
    ("material-icons", "MaterialIcons", "Free"),
    ("material-symbols", "MaterialIcons", "Free"),
    ("bi bi-", "BootstrapIcons", "Free"),
    ("ion-md-", "Ionicons", "Free"),
    ("ion-ios-", "Ionicons", "Free"),
    ("ri-", "RemixIcon", "Free"),
    ("las la-", "LineAwesome", "Free"),
    ("bx bx-", "BoxIcons", "Free"),
]
# Hosts of trackers, provider and concern.
TRACKERS = [
    ("google-analytics.com", "Google Analytics", "Tracks user behavior, requires privacy notice"),
    ("googletagmanager.com", "Google Tag Manager", "Container for tracking scripts, requires privacy notice"),
    ("facebook.net/en_US/fbevents.js", "Facebook Pixel", "Tracks user behavior for ad targeting"),
    ("connect.facebook.net", "Facebook SDK", "Social integration and tracking"),
    ("snap.licdn.com", "LinkedIn Insight", "Professional tracking and retargeting"),
    ("static.hotjar.com", "Hotjar", "Session recording and heatmaps"),
    ("js.hs-scripts.com", "HubSpot", "Marketing automation tracking"),
    ("cdn.segment.com", "Segment", "Data collection and forwarding"),
    ("cdn.mxpnl.com", "Mixpanel", "Product analytics"),
    ("plausible.io", "Plausible", "Privacy-friendly analytics"),
    ("umami.is", "Umami", "Privacy-friendly analytics"),
]
# Signatures of style frameworks, framework and licence.
CSS_FRAMEWORKS = [
    ("bootstrap", "Bootstrap", "MIT"),
    (".container-fluid", "Bootstrap", "MIT"),
    ("tailwindcss", "Tailwind", "MIT"),
    ("@tailwind", "Tailwind", "MIT"),
    ("foundation-", "Foundation", "MIT"),
    (".columns", "Foundation", "MIT"),
    ("bulma", "Bulma", "MIT"),
    (".is-primary", "Bulma", "MIT"),
    ("material-components", "MaterialDesign", "MIT"),
    ("mdc-", "MaterialDesign", "MIT"),
    ("semantic-ui", "SemanticUi", "MIT"),
    ("uikit", "UIKit", "MIT"),
    ("primer", "Primer", "MIT"),
]
# Prefixes of embedded assets.
DATA_PREFIXES = [
    "data:image/png;base64,",
    "data:image/jpeg;base64,",
    "data:image/gif;base64,",
    "data:image/svg+xml;base64,",
    "data:image/webp;base64,",
    "data:font/woff2;base64,",
    "data:font/woff;base64,",
    "data:font/ttf;base64,",
    "data:application/font-woff;base64,",
    "data:application/font-woff2;base64,",
]
# Scraping libraries.
SCRAPERS = [
    "puppeteer",
    "playwright",
    "cheerio",
    "jsdom",
    "crawler",
    "scrapy",
    "selenium",
    "nightmare",
]
