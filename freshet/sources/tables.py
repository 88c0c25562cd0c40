"""Column declarations of the study's input files.

Each table maps our column name to (name in the file, type).  Names are compared
with punctuation and blanks folded to dots, so ``WR_DOC_ID (Dummy)`` and its
dotted spelling are the same column, while ``Lat`` and ``lat`` stay different.
Identifiers are always text: a station number such as 32E050 reads as a float.
A ``?`` before the file name marks a column that may be absent (then NULL).
"""

SEASONAL = {
    "dated": ("YYYY-MM-DD(DOY)", "string"), "crop": ("crop", "string"),
    "planting_date": ("planting_date", "string"), "harvest_date": ("harvest_date", "string"),
    "yield": ("yield", "double"), "used_biomass": ("used_biomass", "double"),
    "irrig": ("irrig", "double"), "region": ("region", "string"), "site": ("site", "string"),
}
DAILY = {
    "Year": ("Year", "int"), "DOY": ("DOY", "int"),
    "irrig": ("Irrigation cum(timestep)", "double"), "region": ("region", "string"),
    "crop": ("crop", "string"), "site": ("site", "string"),
}
SCENARIO_WINDOW = {
    "simulation": ("simulation", "string"), "start_date": ("start_date", "int"),
    "stop_date": ("stop_date", "int"),
}
CROP_GRID = {
    "crop": ("crop", "string"), "site": ("site", "string"), "region": ("region", "string"),
    "Irrigation": ("Irrigation", "string"), "Grid_Number": ("Grid_Number", "string"),
    "Acres": ("Acres", "double"), "CropArea": ("CropArea", "double"), "lat": ("lat", "double"),
    "long": ("long", "double"), "WR_DOC_ID": ("WR_DOC_ID", "string"),
}
CROP_GRID_BASIN = {
    "crop": ("Crop_Name", "string"), "site": ("site", "string"),
    "Irrigation": ("Irrigation", "string"), "HUC10_NAME": ("HUC10_NAME", "string"),
    "Grid_Number": ("Grid_Number", "string"), "Acres": ("Acres", "double"),
    "CropArea": ("CropAcres", "double"), "lat": ("lat", "double"), "long": ("long", "double"),
    "WR_DOC_ID": ("WR_DOC_ID (Dummy)", "string"),
}
IRRIGATION_EFFICIENCY = {
    "Irrigation": ("Irrigation", "string"), "Efficiency": ("Efficiency", "double"),
    "ML_Fraction": ("ML_Fraction", "double"),
}
MOISTURE = {"crop": ("crop", "string"), "WM_ML_factor": ("WM_ML_factor", "double")}
PRICE = {
    "crop": ("crop", "string"), "mean_Price": ("Mean_price_2020_2023", "double"),
    "mean_price_bef": ("Mean_Price_of_all_time_1979_2023", "double"),
}
WINDOW_DEMAND = {
    "Year": ("Year", "int"), "site": ("site", "string"), "crop": ("crop", "string"),
    "region": ("region", "string"), "simulation": ("simulation", "string"),
    "target_harvest_date": ("target_harvest_date", "int"),
    "irrigation_demand_mm": ("irrigation_demand_mm", "double"),
}
WATER_RIGHT = {
    "FID_WSDA": ("OBJECTID_1", "string"), "crop": ("Crop_Name", "string"),
    "PriorityDate": ("PriorityDa", "string"), "WRDocID": ("WRDocID", "string"),
    "FieldAcres": ("FieldAcres", "double"), "field_lat": ("Lat", "double"),
    "field_long": ("Long", "double"), "IntersectA": ("IntersectA", "double"),
    "lat": ("join_lat", "string"), "long": ("join_lon", "string"), "WRIA": ("WRIA_NM", "string"),
}
FIELD_GRID = {
    "FID_WSDA": ("FID_WSDA", "string"), "crop": ("Crop_Name", "string"),
    "Acres_PF": ("Acres", "double"), "lat": ("lat", "double"), "long": ("long", "double"),
    "field_lat": ("Lat", "double"), "field_long": ("Long", "double"),
    "WRIA_ID1": ("WRIA_ID1", "string"), "WRIA": ("WRIA", "string"),
    "Grid_Number": ("Grid_Number", "string"), "region": ("region", "string"),
    "site": ("site", "string"),
}
INTERRUPTIBLE = {"WR_Doc_ID": ("WR_Doc_ID", "string")}
STATION_OUTLET = {
    "SITENO": ("SITENO", "string"), "SITENAME": ("SITENAME", "string"),
    "LONGDD": ("LONGDD", "double"), "LATDD": ("LATDD", "double"),
    "vic_lat": ("VIC lat", "double"), "vic_long": ("VIC long", "double"),
    "StationCode": ("StationCode", "string"), "station": ("SITENAME1", "string"),
    "outlet": ("outlet", "string"),
}
CONTRIBUTING_CELL = {
    "cell": ("Grid", "string"), "StationCode": ("?StationCode", "string"),
    "SITENO": ("?SITENO", "string"),
}
GAUGE = {
    "SITENO": ("SITENO", "string"), "SITENAME": ("SITENAME", "string"),
    "LONGDD": ("LONGDD", "double"), "LATDD": ("LATDD", "double"),
    "SITEURL": ("SITEURL", "string"), "vic_lat": ("join_lat", "string"),
    "vic_long": ("join_lon", "string"),
}
RULE_GAUGE = {"MIFR_NAME": ("MIFR_NAME", "string"), "SITENO": ("SITENO", "string")}
DISCHARGE = {
    "SITENO": ("site_no", "string"), "Year": ("Year", "int"), "Month": ("Month", "int"),
    "Day": ("Day", "int"), "DOY": ("DOY", "int"), "Discharge_cfs": ("Discharge_cfs", "double"),
}
#: rule tables are wide: these, then one text column per rule site
RULE_IDS = ["Month", "Start_date", "End_date"]
