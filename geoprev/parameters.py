"""Marker lists, excluded countries and regions, palettes, grid and model settings of the published maps."""

# Fixed values, stated as they must be for equal results.
KEY_MUTATIONS = ["k13:622:I", "k13:675:V", "k13:561:H", "k13:comb"]
AREA_MUTATIONS = ["k13:comb", "k13:675:V", "k13:622:I", "k13:469:Y", "k13:561:H", "k13:574:L", "k13:441:L", "k13:449:A", "k13:469:F"]
ALL_MUTATIONS = [
    "k13:comb", "k13:675:V", "k13:622:I", "k13:469:Y", "k13:446:I", "k13:458:Y", "k13:476:I", "k13:493:H", "k13:539:T",
    "k13:543:T", "k13:553:L", "k13:561:H", "k13:574:L", "k13:580:Y", "k13:441:L", "k13:449:A", "k13:469:F", "k13:481:V",
    "k13:515:K", "k13:527:H", "k13:537:I", "k13:537:D", "k13:538:V", "k13:568:G",
]
PARTNER_DRUG_MUTATIONS = ["mdr1:86:Y", "crt:76:T"]
NON_MALARIA_COUNTRIES = ["Egypt", "Morocco", "Libya", "Tunisia", "Algeria", "Cabo Verde", "Lesotho", "Mauritius", "Seychelles"]
EXCLUDED_REGIONS = [(region, ["k13:561:H", "k13:675:V", "k13:comb"]) for region in ("Lake Kivu", "Lake Victoria", "Sud-Kivu", "Nord-Kivu")]
COUNTRY_COLOURS = {
    "Burundi": "#CC79A7", "Democratic Republic of the Congo": "#7F7F7F", "Kenya": "#56B4E9", "Uganda": "#0072B2", "Sudan": "#E69F00",
    "South Sudan": "#009E73", "Rwanda": "#D55E00", "Ethiopia": "#332288", "Eritrea": "#882255", "Tanzania": "#44AA99",
}
#: Ten colours for eleven breaks: colour stops are interpolated, the last break has the last colour.
PREVALENCE_COLOURS = ["#5E3A9B", "#8cc4e0", "#a8ecbf", "palegreen3", "khaki2", "#f3c86b", "orange", "hotpink", "red", "darkred"]
PREVALENCE_CUTOFF = 0.1
HIGH_RISK = 0.8
