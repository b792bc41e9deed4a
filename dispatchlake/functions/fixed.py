"""Word lists, tables and weights that results depend on."""

ADDRESS_STOP = "at the a an for on in near and or of to from with no mi michigan detroit road rd avenue ave street st drive dr boulevard blvd highway hwy lane ln court ct usa place pl way north south east west n s e w ne nw se sw".split()
DIFFERENT_STOP = "detroit michigan mi road rd avenue ave street st drive dr boulevard blvd lane ln highway hwy court ct place pl way north south east west n s e w and at the a of in on for plymouth northville livonia dearborn royal oak".split()
STREET_SUFFIX = "road rd avenue ave street st drive dr boulevard blvd highway hwy lane ln court ct place pl way mile".split()
CONTEXT_WORDS = "at on to from near corner block address location reported scene respond heading area box rung".split()
DIRECTIONS = "north south east west n s e w ne nw se sw".split()
PLACE_WORDS = "apartments apartment apt complex bend landing commons place park center centre plaza manor village crossing pointe ridge glen woods lakes club academy school hospital mall station tower towers court courts estates grove meadows heights terrace gardens green square field fields falls creek lake pond trail sanctuary reserve recreation arena stadium theater theatre church cathedral mosque temple synagogue university college institute library museum elementary middle high technical casino hotel motel inn suites lodge restaurant bar grill lounge warehouse factory plant facility garage lot ramp terminal shelter clinic lofts flats townhomes condos".split()
UNIT_BLACKLIST = ["UNKNOWN", "UNIT", "CAR", "NONE", "NULL", "N/A", "NA", "UNK", "COPY", "CLEAR", "RADIO", "DISPATCH", "CONTROL", "BASE", "CHANNEL", "FREQ", "FREQUENCY"]
UNIT_ADDRESS_WORDS = "avenue ave street st road rd boulevard blvd drive dr lane ln court ct place pl way highway hwy expressway freeway trail terrace dexter nashville gratiot mound woodward jefferson michigan warren mcnichols fenkell joy schoolcraft plymouth telegraph livernois wyoming greenfield evergreen southfield lahser inkster middlebelt merriman newburgh beech haggerty napier sheldon beck five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
UNIT_PREFIXES = ["ENGINE", "LADDER", "MEDIC", "CHIEF", "RESCUE", "TRUCK", "SQUAD", "BATTALION", "DEPUTY", "E", "L", "M", "T", "R", "A", "B", "C", "D"]
#: (start of a feed's id, agency), in order
AGENCIES = [("wayneco_detroit_police", "DPD"), ("wayneco_detroit_fire", "DFD"), ("wayneco_detroit_ems", "EMS"), ("wayneco_downriver", "DNR"), ("wayneco_dearborn", "DBN"), ("wayneco_westland", "WLD"), ("wayneco_grossepointe", "GPT"), ("wayneco_plymouthnorthville", "PLY"), ("wayneco_southwestern", "SWN"), ("wayneco_romulus", "ROM"), ("wayneco_northville", "NVL"), ("wayneco_franklin", "FRK"), ("wayneco_public_safety", "WCO"), ("oaklandco", "OAK"), ("washtenaw", "WSH")]
UNIT_TTL_DEFAULT = 28800
#: (feed, seconds that a unit stays assigned), in order
UNIT_TTL = [("wayneco_public_safety", 1800), ("wayneco_downriver", 2700), ("washtenaw_metro", 2700), ("washtenaw_livingston", 2700), ("wayneco_detroit_police_fire", 3600), ("wayneco_detroit_police_dispatch", 3600), ("wayneco_detroit_fire", 3600), ("wayneco_detroit_ems", 3600), ("wayneco_plymouthnorthville", 3600)]
BUSY_FEEDS = ["wayneco_public_safety", "wayneco_downriver", "wayneco_detroit_police_dispatch", "wayneco_detroit_police_fire", "wayneco_detroit_fire", "wayneco_detroit_ems", "washtenaw_metro", "washtenaw_livingston", "wayneco_southwestern"]
#: feed: latitude and longitude of its area's centre, radius in km, main city
FEED_AREAS = {
    "wayneco_detroit_police_fire": (42.33, -83.05, 15.0, "Detroit"),
    "wayneco_detroit_police_dispatch": (42.33, -83.05, 15.0, "Detroit"),
    "wayneco_detroit_fire": (42.33, -83.05, 15.0, "Detroit"),
    "wayneco_detroit_ems": (42.33, -83.05, 15.0, "Detroit"),
    "wayneco_downriver": (42.19, -83.18, 20.0, None),
    "wayneco_westland_gardencity": (42.32, -83.40, 10.0, "Westland"),
    "wayneco_dearborn": (42.32, -83.18, 10.0, "Dearborn"),
    "wayneco_grossepointe": (42.39, -82.92, 10.0, "Grosse Pointe"),
    "wayneco_plymouthnorthville": (42.37, -83.47, 15.0, "Plymouth"),
    "wayneco_southwestern": (42.24, -83.52, 15.0, "Van Buren Township"),
    "wayneco_public_safety": (42.33, -83.20, 40.0, None),
    "wayneco_romulus": (42.22, -83.37, 12.0, "Romulus"),
    "wayneco_northville_plymouth_city": (42.43, -83.48, 12.0, "Northville"),
    "wayneco_franklin_bingham": (42.52, -83.30, 10.0, "Franklin"),
    "oaklandco_royaloak_fire": (42.49, -83.14, 10.0, "Royal Oak"),
    "washtenaw_metro": (42.28, -83.74, 25.0, "Ann Arbor"),
    "washtenaw_livingston": (42.60, -83.93, 25.0, "Howell"),
}
DEFAULT_AREA = (42.33, -83.05, 40.0, None)
INCOMPATIBLE = [("STRUCTURE_FIRE", "MEDICAL"), ("STRUCTURE_FIRE", "SHOOTING"), ("STRUCTURE_FIRE", "WELFARE_CHECK"), ("STRUCTURE_FIRE", "ASSAULT"), ("VEHICLE_FIRE", "MEDICAL"), ("VEHICLE_FIRE", "WELFARE_CHECK"), ("SHOOTING", "WELFARE_CHECK"), ("SHOOTING", "MEDICAL"), ("PURSUIT", "WELFARE_CHECK"), ("PURSUIT", "MEDICAL"), ("HAZMAT", "ASSAULT"), ("HAZMAT", "SHOOTING"), ("BOMB_THREAT", "MEDICAL"), ("BOMB_THREAT", "WELFARE_CHECK")]
WEIGHTS = {"overlap": 0.30, "proximity": 0.25, "unit": 0.20, "type": 0.10, "burst": 0.08, "feed": 0.05, "street": 0.10, "unit_feed": 0.05, "busy_unit": -0.10, "old": -0.15, "far": -0.20}
STRONG, WEAK, AMBIGUOUS = 0.85, 0.50, 0.20
#: km below which a share of the proximity weight counts
PROXIMITY = [(0.2, 1.0), (0.5, 0.85), (1.0, 0.65), (2.0, 0.40), (5.0, 0.15)]
GEOCODER_BOX, LAYER_BOX = (41.9, 43.0, -84.1, -82.5), (42.0, 43.1, -84.1, -82.5)
CRIME_COLOURS = [("HOMICIDE", "#ff0000"), ("SEXUAL ASSAULT", "#ff4499"), ("ROBBERY", "#ff6600"), ("ASSAULT", "#ff8800"), ("BURGLARY", "#ffaa00"), ("VEHICLE THEFT", "#ffcc00"), ("LARCENY", "#ffee00"), ("ARSON", "#ff4400"), ("OTHER", "#888888")]
LANDMARKS = {
    "mgm": "MGM Grand Detroit Casino, Detroit, MI", "mgm casino": "MGM Grand Detroit Casino, Detroit, MI", "mgm grand": "MGM Grand Detroit Casino, Detroit, MI",
    "greektown": "Greektown Casino, Detroit, MI", "greektown casino": "Greektown Casino, Detroit, MI", "motorcity casino": "MotorCity Casino, Detroit, MI", "motor city casino": "MotorCity Casino, Detroit, MI",
    "dmc": "Detroit Medical Center, Detroit, MI", "harper": "Harper University Hospital, Detroit, MI", "sinai": "Sinai-Grace Hospital, Detroit, MI", "grace": "Sinai-Grace Hospital, Detroit, MI",
    "beaumont": "Beaumont Hospital, Royal Oak, MI", "providence": "Providence Hospital, Southfield, MI", "henry ford": "Henry Ford Hospital, Detroit, MI", "receiving": "Detroit Receiving Hospital, Detroit, MI",
    "childrens": "Children's Hospital of Michigan, Detroit, MI", "ford field": "Ford Field, Detroit, MI", "little caesars arena": "Little Caesars Arena, Detroit, MI", "lca": "Little Caesars Arena, Detroit, MI",
    "comerica": "Comerica Park, Detroit, MI", "comerica park": "Comerica Park, Detroit, MI",
    "metro airport": "Detroit Metropolitan Wayne County Airport, Romulus, MI", "dtwatx": "Detroit Metropolitan Wayne County Airport, Romulus, MI", "dtw": "Detroit Metropolitan Wayne County Airport, Romulus, MI",
    "coleman young": "Coleman A. Young Municipal Airport, Detroit, MI", "belle isle": "Belle Isle Park, Detroit, MI", "chandler park": "Chandler Park, Detroit, MI", "clark park": "Clark Park, Detroit, MI",
    "rouge park": "Rouge Park, Detroit, MI", "palmer park": "Palmer Park, Detroit, MI", "milliken state park": "Milliken State Park, Detroit, MI", "hart plaza": "Hart Plaza, Detroit, MI",
    "cobo": "Huntington Place, Detroit, MI", "renaissance center": "Renaissance Center, Detroit, MI", "ren cen": "Renaissance Center, Detroit, MI",
    "fairlane": "Fairlane Town Center, Dearborn, MI", "fairlane town center": "Fairlane Town Center, Dearborn, MI", "somerset": "Somerset Collection, Troy, MI", "twelve oaks": "Twelve Oaks Mall, Novi, MI",
    "lakeside": "Lakeside Mall, Sterling Heights, MI", "partridge creek": "Partridge Creek Mall, Clinton Township, MI", "wayne state": "Wayne State University, Detroit, MI",
    "u of d": "University of Detroit Mercy, Detroit, MI", "uofm dearborn": "University of Michigan-Dearborn, Dearborn, MI", "madonna": "Madonna University, Livonia, MI",
}
COUNTIES = {
    "wayneco_downriver": "wayne", "wayneco_detroit_police_fire": "wayne", "wayneco_detroit_police_dispatch": "wayne", "wayneco_detroit_fire": "wayne", "wayneco_public_safety": "wayne", "wayneco_westland_gardencity": "wayne",
    "wayneco_dearborn": "wayne", "wayneco_grossepointe": "wayne", "wayneco_plymouthnorthville": "wayne", "wayneco_southwestern": "wayne", "wayneco_detroit_ems": "wayne", "wayneco_romulus": "wayne",
    "wayneco_northville_plymouth_city": "wayne", "wayneco_franklin_bingham": "wayne", "oaklandco_royaloak_fire": "oakland", "washtenaw_metro": "washtenaw", "washtenaw_livingston": "livingston",
}
#: name, primary city, county and note of a feed of which nothing is known
DEFAULT_CONTEXT = ("Metro Detroit Public Safety", "Metro Detroit", "Wayne County", "Metro Detroit area. Use cross streets and context to determine most likely city.")
#: said before an address by a model that was to give it alone
SAID_BEFORE = ["the address is", "the location is", "normalized address:", "address:", "location:", "result:", "output:", "answer:"]
#: words that make a model's long answer an address
ANSWER_WORDS = "road avenue street drive boulevard highway mile rd ave st dr blvd hwy no_location".split()
#: parts of words that make the first part of an address more than a city
CITY_STREETS = ["road", "ave", "street", "drive", "blvd", "lane", "court", "way", "hwy"]
#: kinds of places that a search gives back which are too wide, and which are near enough
WIDE_PLACES = "locality administrative_area_level_1 administrative_area_level_2 administrative_area_level_3 country postal_code political".split()
NEAR_PLACES = "neighborhood sublocality sublocality_level_1 park establishment point_of_interest premise natural_feature".split()
#: class of an incident type's tag; any other type with FIRE in it is fire
TAG_CLASSES = {
    "MEDICAL": "medical", "SUICIDE": "medical", "SHOOTING": "shooting", "ASSAULT": "shooting", "DOMESTIC": "shooting", "ROBBERY": "shooting", "BURGLARY": "shooting", "USE_OF_FORCE": "shooting", "SHAKEN_AND_BATTERED": "shooting",
    "HAZMAT": "hazmat", "HAZARD": "hazmat", "BOMB_THREAT": "hazmat", "PURSUIT": "police", "WELFARE_CHECK": "police", "SUSPICIOUS": "police", "COMMERCE": "police", "ASSIST_CITIZEN": "police",
}
INCIDENT_COLOURS = {
    "STRUCTURE_FIRE": "#ff3d00", "VEHICLE_FIRE": "#ff6d00", "FIRE": "#ff9100", "MEDICAL": "#03a9f4", "SUICIDE": "#7986cb", "SHOOTING": "#d50000", "ASSAULT": "#ff1744", "SHAKEN_AND_BATTERED": "#f50057", "DOMESTIC": "#e040fb", "USE_OF_FORCE": "#aa00ff",
    "ROBBERY": "#ff6f00", "BURGLARY": "#ffa000", "THEFT": "#ffd600", "COMMERCE": "#f9a825", "RECOVERY_AUTO": "#ffb300", "PURSUIT": "#304ffe", "SUSPICIOUS": "#448aff", "WELFARE_CHECK": "#40c4ff", "PRISONER": "#1565c0",
    "ASSIST_CITIZEN": "#00c853", "ANIMAL_CONTROL": "#69f0ae", "HAZMAT": "#aeea00", "HAZARD": "#c6ff00", "BOMB_THREAT": "#ffea00", "TRAFFIC_ACCIDENT": "#00bfa5", "TRAFFIC": "#80cbc4", "OTHER": "#90a4ae", "UNKNOWN": "#546e7a",
}
