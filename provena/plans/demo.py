"""Programs of the registered queries, over the order tables."""

PIPELINE = """
/* revenue of order lines, margins and dues */
data staged;
  set lineitem;
  revenue = l_extendedprice * (1 - l_discount);
  charge = revenue * (1 + l_tax);
run;
data margins;
  set staged;
  net = revenue - l_quantity * unit_cost;
  margin = net / revenue;
run;
data shipped;
  set staged;
  late_fee = charge * 0.02;
run;
data report;
  merge margins shipped;
  by l_orderkey;
  total_due = charge + late_fee;
  score = MAX(margin, 0);
  label = 'R' || l_returnflag;
run;
proc sort data=report out=final; by l_orderkey; run;
"""

REVENUE = """
data revenue_by_line;
  set lineitem;
  revenue = l_extendedprice * (1 - l_discount);
  charge = revenue * (1 + l_tax);
run;
"""

MACROS = """
%macro yearly(prefix, n);
  %do i = 1 %to &n;
    data &prefix._&i;
      set src_&i;
      amount = base_&i * 2;
    run;
  %end;
%mend;
%yearly(out, 3);
%macro pick(flag);
  %if &flag = Y %then %do; data yes; set a; x = 1; run; %end;
  %else %do; data no; set b; x = 2; run; %end;
%mend;
%pick(N)
"""
